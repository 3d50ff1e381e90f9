"""Similar texts where ids repeat or are null, and acceptance along long chains and in components."""

import random

import duckdb
import pytest

from newsloom.operators import components as C
from newsloom.operators import similarity
from newsloom.operators.similarity import accepted
from newsloom.plans import catalog

TEXT = " ".join(f"subject{i}" for i in range(20))
NEAR = TEXT.replace("subject19", "another19")
OTHER = " ".join(f"different{i}" for i in range(20))
ROWS = [(1, TEXT), (1, TEXT), (1, TEXT), (1, TEXT), (2, NEAR), (2, OTHER), (None, OTHER + " more-of-it"), (None, "short one"), (4000, TEXT)]
MORE = [(None, None), (3, ""), (None, TEXT.upper()), (None, NEAR + " further"), (5000, OTHER), (None, "alone completely different"), (None, "alone completely different")]


@pytest.mark.parametrize("rows", [ROWS, ROWS + MORE, []])
@pytest.mark.parametrize("name", ["j14_near_duplicates", "x7_greedy_dedup", "x3_recent_duplicates"])
def test_a_row_in_a_row_out(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = catalog.queries()[name](spark, str(tmp_path)).select(names).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def loop(links):
    before = {}
    for a, b in links:
        before.setdefault(b, []).append(a)
    out = set()
    for b in sorted(before):
        if any(a not in out for a in before[b]):
            out.add(b)
    return out


def settled(spark, links, **how):
    return {r.id for r in C.rejected(spark.createDataFrame(links, "a long, b long"), **how).collect()}


@pytest.mark.parametrize("most", [500_000, 100])
def test_components_are_settled_as_by_a_loop(spark, most):
    draw = random.Random(most)
    links = [tuple(sorted(draw.sample(range(g, g + 40), 2))) for g in (0, 100, 200) for _ in range(g // 2 + 15)] + [(300 + i, 301 + i) for i in range(60)]
    assert settled(spark, links, most=most) == loop(links)
    assert settled(spark, [(1, 2)], most=most) == {2} and settled(spark, []) == set()


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 500)] + [(600, 601), (601, 700), (5, 900)]
    got = {r.id: r.component for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(501), 900]} | {600: 600, 601: 600, 700: 600}


def test_a_chain_of_ten_thousand_in_few_rounds(spark, monkeypatch):
    rounds, own = [], C.stored
    monkeypatch.setattr(C, "stored", lambda df, name: (rounds.append(name), own(df, name))[1])
    links = [(i, i + 1) for i in range(10_000)] + [(i, i + 2) for i in range(0, 9_999, 7)]
    assert settled(spark, links, most=6_000) == loop(links)  # one component, too large for a task
    assert len(rounds) < 60  # tables written, for all rounds
    rounds.clear()
    assert settled(spark, links) == loop(links) and len(rounds) < 4


def test_acceptance_of_a_chain_of_texts(spark):
    rows = [(i, " ".join(f"token{w}" for w in range(i, i + 8))) for i in range(60)]
    assert {r.doc_id for r in accepted(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.is_accepted} == set(range(0, 60, 2))


def _sets(rows):
    return {i: set(w for w in t.lower().split() if len(w) > 4) for i, t in rows}


def test_near_copies_against_all_pairs(spark):
    dice = random.Random(5)
    rows = []
    for g, size in enumerate((3, 6, 12, 40, 150)):
        base = [f"group{g}word{i}" for i in range(size)]
        rows += [(1000 * g + k, " ".join(w for w in base + [f"extra{dice.randrange(30)}" for _ in range(size // 5)] if dice.random() > 0.12)) for k in range(25)]
    rows += [(9000 + n, " ".join(f"plain{i}" for i in range(n))) for n in range(1, 9)]
    rows = [r for r in rows if _sets([r])[r[0]]]
    sets = _sets(rows)
    alike = lambda x, y: len(x & y) * 100 >= len(x | y) * 70
    want = {i: sum(alike(s, sets[j]) for j in sets if j != i) for i, s in sets.items()}
    got = {r.doc_id: r.n_links for r in similarity.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and sum(want.values()) > 500


def test_sets_that_share_a_few_rare_tokens_are_no_candidates(spark, monkeypatch):
    counts, own = {}, similarity.stored

    def counted(df, name, **options):
        out = own(df, name, **options)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(similarity, "stored", counted)
    rows = [(k, " ".join([f"shared{k // 20}first", f"shared{k // 20}second", *[f"single{k}word{i}" for i in range(60)]])) for k in range(200)]
    rows += [(500 + k, " ".join([f"copied{i}" for i in range(60)] + [f"changed{k}"])) for k in range(30)]
    out = similarity.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert counts["candidates"] == 30 * 29 // 2 and sum(r.n_links for r in out.collect()) == 30 * 29
