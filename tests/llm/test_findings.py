"""What a review found to be less than the whole job."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from newsloom.llm import chat_format, decontaminate, katz_lm, registry, unigram_counts
from newsloom.operators import storage

from . import katz_brute
from .test_text_operators import SF, docs_of


def fitted_factors(counts, k=5):
    """Katz's factors from a log-linear fit of the counts of counts over all r."""
    n = Counter(counts)
    r = sorted(n)
    z = [2 * n[x] / ((r[i + 1] if i + 1 < len(r) else 2 * x - r[i - 1]) - (r[i - 1] if i else 0)) for i, x in enumerate(r)]
    x, y = np.log(r), np.log(z)
    slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    c = (k + 1) ** (slope + 1)
    d = {i: (((i + 1) / i) ** (slope + 1) - c) / (1 - c) for i in range(1, k + 1)}
    assert all(0 < v < 1 for v in d.values())
    return lambda i: d.get(i, 1.0)


def test_katz_discounts_with_copies(spark):
    """Groups of copies swell n(5); words and pairs are Good-Turing discounted all the same."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    uni = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in katz_brute.words_of(t))
    of_counts, want = Counter(uni.values()), fitted_factors(uni.values())
    assert katz_lm.discounts(of_counts) == pytest.approx([1.0, *map(want, range(1, 7))])
    want, cond, p, unk = katz_brute.katz(rows)
    for r in katz_lm.katz_scores(docs_of(spark, rows)).collect():
        assert tuple(r)[1:5] == want[r.doc_id][:4] and r.score == pytest.approx(want[r.doc_id][5])
    assert sum(p.values()) + unk == pytest.approx(1)


def test_discounts_of_clean_and_of_few_counts():
    raw = katz_lm.discounts({1: 1000, 2: 300, 3: 140, 4: 80, 5: 50, 6: 30})
    c = 6 * 30 / 1000
    assert raw[1] == pytest.approx((2 * 300 / 1000 - c) / (1 - c))  # valid factors are not smoothed
    assert katz_lm.discounts({1: 2, 3: 2})[1] == 0.5 and list(katz_lm.discounts({})) == [1.0] * 7


def test_decontamination_keeps_repeated_rows(spark):
    bench = spark.createDataFrame([(2, "Short item")], "item_id long, text string")
    rows = [(1, "a short item"), (1, "a short item"), (1, "other"), (None, "short item"), (None, "short item"), (None, None), (None, None), (None, ""), (3, "x")]
    for most in (decontaminate.BROADCAST_BYTES, 0):
        got = decontaminate.report(decontaminate.hits(docs_of(spark, rows), bench, broadcast_bytes=most)).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, *r["items"]) for r in got) == {(1, 3, 2, "2"): 2, (1, 1, 0): 1, (None, 2, 2, "2"): 2, (None, 0, 0): 3, (3, 1, 0): 1}


def test_turns_without_conversation(spark, tmp_path):
    """Rows of null conv_id are one conversation, as in the SQL."""
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", "a<b"), (0, 0, "user", "x"), (0, 1, "assistant", "y"), (None, 2, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = chat_format.op7_chat_format(spark, str(tmp_path))
    want = con.execute(registry.oracle_sql()["op7_chat_format"])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(want.fetchall(), key=str) and got.count() == 3


def test_reply_trees_spare_the_driver(spark, monkeypatch):
    """Rounds broadcast nothing, write one table each and leave the last one only, without a marker file."""
    plans, tables = [], []

    def noted(df, name, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        tables.append(storage.stored(df, name, **options))
        return tables[-1]

    monkeypatch.setattr(chat_format, "stored", noted)
    rows = [(tree, node, node - 1 if node else None, 1.0, "user", f"{tree} {node}") for tree in range(40) for node in range(9)]
    nodes = spark.createDataFrame([*rows, (0, None, None, 1.0, "user", "x"), (0, None, 8, 1.0, "user", "y")], "tree long, node long, parent long, score double, role string, text string")
    found = chat_format.paths(nodes)
    out = chat_format.formatted(nodes, chat_format.best_paths(found))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, found.collect())) == [(tree, list(range(9)), 9.0) for tree in range(40)] and out.count() == 40
    assert not any("Broadcast" in p for p in plans)
    assert len(tables) == 6  # links, what leaves reach, four rounds for eight steps
    assert [t for t in tables if storage.exists(spark, t.stored_at)] == tables[-1:]
    assert not storage.exists(spark, f"{tables[-1].stored_at}/_SUCCESS")


def test_unigram_counts_like_the_library(spark):
    from tokenizers import Tokenizer, models

    pieces = unigram_counts.vocabulary(unigram_counts.piece_path())
    least = min(s for _, s in pieces)
    theirs = Tokenizer(models.Unigram([("<unk>", least), *pieces, *[(f"<0x{i:02X}>", least) for i in range(256)]], 0, True))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in unigram_counts.op9_unigram_counts(spark, SF).collect():
        words = unigram_counts.WORDS.findall(texts[r.doc_id] or "")
        assert (r.n_words, r.n_tokens) == (len(words), sum(len(theirs.encode(unigram_counts.MARK + w).ids) for w in words))


def test_quality_learns_each_id_once(spark, monkeypatch):
    """The bound on labelled rows holds whatever the copies of one id, and the order of rows doesn't matter."""
    from pyspark.sql import functions as F

    from newsloom.llm import quality_fm

    rows = [(1, f"copy {i % 3}") for i in range(5000)] + [(i, f"text {i}") for i in range(2, 39)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 39)], "doc_id long, quality int")
    learnt = []
    keep = quality_fm.stored
    monkeypatch.setattr(quality_fm, "stored", lambda df, name: (learnt.append((keep(df, name))), learnt[-1])[1])
    weights = [quality_fm.fit(docs_of(spark, r), labels, F.array(F.lit("m")), sample=s).all for r, s in ((rows, 20), (rows, 100), (rows[::-1], 100))]
    assert [t.count() for t in learnt] == [20, 38, 38] and (weights[1] == weights[2]).all()


def test_items_without_an_id_count_as_one(spark):
    bench = spark.createDataFrame([(None, "one two"), (None, "two three"), (4, "one two"), (5, None), (None, None)], "item_id long, text string")
    rows = [(1, "one two three"), (2, "two three"), (3, "one"), (None, "one two")]
    for most in (decontaminate.BROADCAST_BYTES, 0):
        got = {r.doc_id: (r.n_hit, r.n_items, r["items"]) for r in decontaminate.report(decontaminate.hits(docs_of(spark, rows), bench, broadcast_bytes=most)).collect()}
        assert got == {1: (3, 2, ["4", None]), 2: (2, 1, [None]), 3: (0, 0, []), None: (2, 2, ["4", None])}
