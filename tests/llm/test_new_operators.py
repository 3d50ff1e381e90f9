"""The forest, periodic runs and the Merkle manifest against plain versions, and over odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import embedding_forest as E
from newsloom.llm import merkle as M
from newsloom.llm import periodic_runs as P
from newsloom.llm import registry

from .test_text_operators import SF, docs_of

# --- embeddings


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


def linked(rows, like=0.9):
    """For each row: links, and the least id reachable, by all pairs."""
    x = [np.array(v, np.float64) if v and None not in v else None for _, v, _ in rows]
    good = [v is not None and np.isfinite(np.square(v).sum()) and bool(v.any()) for v in x]
    alike = [[i != j and good[i] and good[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt(x[i] @ x[i]) / np.sqrt(x[j] @ x[j]) >= like for j in range(len(x))] for i in range(len(x))]
    out = []
    for i in range(len(x)):
        seen, open_ = {i}, [i]
        while open_:
            new = {j for j, a in enumerate(alike[open_.pop()]) if a} - seen
            seen |= new
            open_ += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], sum(alike[i]), min(ids, default=None)))
    return Counter(out)


def found(df):
    return Counter((r.vec_id, r.n_links, r.component_id) for r in df.collect())


def unit(x):
    return x / np.sqrt(np.square(x).sum(-1, keepdims=True))


def groups(seed, length=16):
    """Lone vectors, pairs near the threshold, a tight group, and one that is wider than a ball."""
    draw = np.random.default_rng(seed)
    lone = unit(draw.standard_normal((150, length)))
    aside = draw.standard_normal((60, length))
    aside = unit(aside - (aside * lone[:60]).sum(1)[:, None] * lone[:60])
    c = draw.uniform(0.9005, 0.93, 60)[:, None]
    tight = unit(unit(draw.standard_normal(length)) + 0.02 * draw.standard_normal((120, length)))
    wide = unit(unit(draw.standard_normal(length)) + 0.09 * draw.standard_normal((120, length)))
    x = np.concatenate([lone, lone[:60] * c + aside * np.sqrt(1 - c * c), tight, wide, tight[:5], wide[:5] * 3])
    return [(int(i), [float(np.float32(v)) for v in row], 0) for i, row in zip(draw.permutation(len(x)), x, strict=True)]


@pytest.mark.parametrize("seed,leaf,few", [(1, 64, 64), (2, 32, 0)])
def test_forest(spark, seed, leaf, few, monkeypatch):
    monkeypatch.setattr(E, "TILE", 32)
    monkeypatch.setattr(E, "FEW", few)
    monkeypatch.setattr(E, "CHUNK", 50)
    monkeypatch.setattr(E, "DEPTH", 2)  # so that several rounds are needed
    rounds, own = [], E._Forest._round
    monkeypatch.setattr(E._Forest, "_round", lambda *a: (rounds.append(1), own(*a))[1])
    rows = groups(seed)
    df = vectors_of(spark, rows)
    got = E.near_duplicates(df, leaf=leaf, trees=12)
    assert len(rounds) >= 4
    want, links = linked(rows), found(got)
    # no link too many, and few too little
    most = {k[0]: k[1] for k in want}
    assert all(n <= most[i] for i, n, _ in links)
    assert sum(n for _, n, _ in links) >= 0.99 * sum(most.values())
    assert E.recall(df, got, F.expr("vec_id % 5 = 0")) >= 0.98


def test_forest_has_balls_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(E, "TILE", 32)
    rows = groups(3)
    named = spark.createDataFrame([(i, 1, bytearray(np.array(v, "<f4").tobytes())) for i, v, _ in rows], "id long, n long, v binary")
    balls = E._Forest(named, True, 0.9, 4, 32).grown([0]).where("ball IS NOT NULL")
    x = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    members = {}
    for r in balls.collect():
        members.setdefault(r.ball, []).append(x[r.id])
    assert max(map(len, members.values())) > 64 and all((np.array(m) @ np.array(m).T >= 0.9).all() for m in members.values())


def test_forest_odd_rows(spark):
    e = [1.0, 0.5, 0.0]
    rows = [
        (5, e, 1), (5, e, 2), (5, [0.0, 0.0, 1.0], 1), (None, [2.0, 1.0, 0.0], 1), (None, [0.0, 1.0, -5.0], 1), (7, None, 1), (8, [], 1), (9, [0.0, 0.0, 0.0], 1), (10, [1.0, None, 0.5], 1),
        (11, [float("nan"), 1.0, 0.0], 1), (12, [float("inf"), 1.0, 0.0], 1), (13, [1.0, 0.5], 1), (3, [1.0, 0.5, -0.0], 1), (14, [4e19, 2e19, 0.0], 1),
    ]
    for kind in ("float", "double"):
        df = vectors_of(spark, rows, kind).withColumn("n_links", F.lit(1)).withColumn("key", F.lit("x"))
        got = E.near_duplicates(df)
        assert found(got) == linked(rows) and got.columns == ["vec_id", "n_links", "component_id", "kept"]
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())
    assert E.near_duplicates(vectors_of(spark, [])).collect() == [] and E.near_duplicates(vectors_of(spark, [(1, None, 0)])).count() == 1


def test_forest_query(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert found(registry.queries()["op11_embedding_forest"](spark, SF)) == linked([(r.vec_id, r.embedding, 0) for r in t.collect()])


# --- periodic runs


def plain_runs(words, times=4, least=6):
    out = {}
    for q in range(1, len(words) // times + 1):
        start = 0
        while start < len(words) - q:
            end = start
            while end < len(words) - q and words[end] == words[end + q]:
                end += 1
            if end > start and end - start + q >= max(least, times * q):
                out.setdefault((start, end - start + q), q)
            start = end + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


@pytest.mark.parametrize("key", [1, 2, 8])
def test_runs_of_random_words(key, monkeypatch):
    monkeypatch.setattr(P, "KEY", key)
    draw = random.Random(key)
    for _ in range(400):
        n = draw.choice([0, 1, 5, 6, 20, 60, 300])
        words = [draw.randrange(draw.choice([1, 2, 3, 6])) for _ in range(n)]
        if n > 10 and draw.random() < 0.7:
            a = draw.randrange(n)
            p = 1 + (n - a) // (3 + draw.randrange(8))
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        for times, least in ((4, 6), (3, 3)):
            assert P.runs_of(np.array(words, np.int64), times, least) == plain_runs(words, times, least)


def test_runs_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in registry.queries()["op12_periodic_runs"](spark, SF).collect()}
    sha, some = lambda t: hashlib.sha256(t.encode()).hexdigest(), 0
    for i, text in docs.items():
        words = planted(text.encode().split(), i)
        runs = plain_runs(words)
        some += len(runs)
        s, n, q = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert got[i] == (len(runs), s, n, q, n and 1000 * n // q, sha(lines), sha(b" ".join(plain_collapsed(words, runs)).decode()))
    assert some > 5 and len(got) == len(docs)


def test_runs_of_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, " \t\n"), (None, "a " * 50_000), (3, "a b " * 5 + "\xa0 x"), (4, "Ha ha HA " * 4)]
    df = docs_of(spark, rows).withColumn("runs", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in P.periodic_runs(df).collect())
    assert got == {(1, 0, (), ""): 2, (2, 0, (), ""): 1, (None, 0, (), ""): 1, (None, 50_000, ((0, 50_000, 1),), "a"): 1, (3, 12, ((0, 10, 2),), "a b \xa0 x"): 1, (4, 12, ((0, 12, 3),), "Ha ha HA"): 1}
    assert P.periodic_runs(docs_of(spark, [])).collect() == []
    h = F.col("doc_id")
    rows = [(10, None), (20, ""), (30, "a b c d e f g h"), (31, "a b")]  # of eight words and g = 3 those from the fourth on become d, d, d, ...
    assert [r[0] for r in spark.createDataFrame(rows, "doc_id long, text string").select(P.looped(F.col("text"), h)).collect()] == [None, "", "a b c d d d d d", "a b"]


def test_long_repetitive_text():
    assert P.runs_of(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    assert P.runs_of(np.arange(70_000) % 7_000) == [(0, 70_000, 7_000)]


# --- Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes, fanout):
    """The root of nodes, and each node's siblings from below to above."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(places):
            run = range(at // fanout * fanout, min(at // fanout * fanout + fanout, len(nodes)))
            paths[k].append(("".join(nodes[i] for i in run if i < at), "".join(nodes[i] for i in run if i > at)))
            places[k] = at // fanout
        nodes = [digest(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plain_manifest(rows, fanout):
    """rows: doc_id, source, lang, n_chars, text"""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r[0]))
    langs = dict(sorted(langs.items(), key=lambda x: (x[0] is not None, (x[0] or "").encode())))
    own = {k: climb([x[2] for x in sorted(v, key=lambda x: x[:3])], fanout) for k, v in langs.items()}
    root, above = climb([own[k][0] for k in langs], fanout)
    out = Counter()
    for k, path in zip(langs, above, strict=True):
        for x, p in zip(sorted(langs[k], key=lambda x: x[:3]), own[k][1], strict=True):
            out[x[3], x[2], own[k][0], root, (*p, *path)] += 1
    return out


def manifest(df, **how):
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.proof))) for r in M.manifest(df, **how).collect())


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string, leaf string"


@pytest.mark.parametrize("fanout,block,top", [(2, 4, 1000), (3, 1, 7), (2, 4096, 16_384), (5, 5, 1000)])
def test_manifest(spark, fanout, block, top):
    draw = random.Random(fanout * block)
    rows = [(draw.choice([None, *range(60)]), draw.choice(["s", None]), draw.choice(["de", "", None, "é", "z", "z", "z"]), draw.choice([None, 3]), draw.choice([None, "", "ü", "x" * 3000])) for _ in range(150)]
    rows += [(7, "s", "z", 1, "same")] * 40 + [(1, "s", "lone", 1, "t")]
    df = spark.createDataFrame([(*r, "k", "l") for r in rows], SCHEMA).repartition(3)
    assert manifest(df, fanout=fanout, block=block, top=top) == plain_manifest(rows, fanout)


def test_manifest_of_few_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert M.manifest(df).collect() == []
    one = spark.createDataFrame([(None, None, None, None, None, "", "")], SCHEMA)
    leaf = digest("-----")
    assert [tuple(r) for r in M.manifest(one).collect()] == [(None, leaf, None, leaf, leaf, [])]
    got = M.manifest(spark.createDataFrame([(i, "s", "x", 1, "t", "", "") for i in range(5)], SCHEMA), group=None, altered=F.col("source"))
    assert {r.altered for r in got.collect()} == {"s"} and got.where(M.folded(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 5
    assert got.where(M.folded(F.lit("0" * 64), F.col("proof")) == F.col("root")).count() == 0


def test_manifest_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(registry.oracle_sql()["op13_merkle"])
    names = [c[0] for c in want.description]
    got = registry.queries()["op13_merkle"](spark, SF)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())
    hit = {i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 0}
    assert {r.doc_id for r in got.where("NOT verified").collect()} == hit and hit
