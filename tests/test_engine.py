"""Operators, streams, and every query against its SQL on the smallest tables."""

import json
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from newsloom.operators import relational as R
from newsloom.operators.similarity import accepted, near_duplicates
from newsloom.plans import catalog
from newsloom.streaming.feeds import ingest, rolling_inventory

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows, columns):
    each = lambda v: None if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(each(r[c]) for c in sorted(columns)) for r in rows) if not any(v is None for r in rows for v in r.values()) else sorted((tuple(each(r[c]) for c in sorted(columns)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    if name in catalog.oracle_sql():
        found = duck.execute(catalog.oracle_sql()[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        assert rows, "no rows on either side prove nothing"
        assert plain(rows, names) == plain([dict(zip(names, r, strict=True)) for r in found.fetchall()], names)


def test_entry_and_filters(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 125
    df = spark.range(10).withColumn("v", F.col("id") % 3)
    assert R.where_given(df, v=[0, 1], id=None).count() == 7
    assert [r.id for r in R.page(df, [F.desc("id")], 0, 4).collect()] == [9, 8, 7, 6]
    assert R.page(df, ["id"], 1, 10_000).count() == 10


def test_plans(spark):
    plan = catalog.queries()["a5_article_total"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan and "o_totalprice" not in plan


def chain(words):
    return " ".join(f"token{w}" for w in words)


def test_greedy_acceptance(spark):
    rows = [(1, chain(range(1, 9))), (2, chain(range(2, 10))), (3, chain(range(3, 11))), (4, "a b"), (5, None), (6, chain(range(1, 9))), (7, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in accepted(docs).collect() if r.is_accepted} == {1, 3, 4, 5, 7}
    links = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(docs).collect()}
    assert links == {1: (1, 2), 2: (2, 3), 3: (3, 1), 4: (None, 0), 5: (None, 0), 6: (1, 2), 7: (None, 0)}


def test_greedy_acceptance_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    taken, want = [], set()
    for r in sorted(docs.collect()):
        t = {w for w in r.text.lower().split() if len(w) > 4}
        if not any(len(t & o) * 100 >= 70 * len(t | o) for o in taken if t | o):
            taken.append(t)
            want.add(r.doc_id)
    assert {r.doc_id for r in accepted(docs).collect() if r.is_accepted} == want


def test_versions(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(R.upserted(old, new, "id")) == [(1, "a"), (2, "c"), (3, "d")]
    assert got(R.upserted(old, new, "id", update=False)) == [(1, "a"), (2, "b"), (3, "d")]
    assert got(R.without_keys(old, new, "id")) == [(1, "a")]
    assert got(R.updated(old, F.col("id") == 1, v="z")) == [(1, "z"), (2, "b")]


def test_auto_approval(spark):
    risks = spark.createDataFrame([(0.3, 0.8, "x"), (0.31, 0.9, "x"), (0.1, 0.79, None)], "score double, confidence double, category string")
    rules = spark.createDataFrame([("", 0.3, 0.8, True, True), ("tech", 1.0, 0.0, True, True)], "category string, max_score double, min_confidence double, is_active boolean, auto_approve boolean")
    assert [tuple(r) for r in R.auto_approved(risks, rules).collect()] == [(0.3, 0.8, "x")]


def item(k, source="s", body=None):
    body = body or " ".join(f"subject{k}word{i}" for i in range(9))
    return {"title": f"Cricket {k}", "link": f"http://x/{k}", "pubDate": "Tue, 02 Jan 2024 03:04:05 GMT", "content": f"<img src='a.png'> {body}", "source_id": source, "source_name": "Daily", "item_pos": k}


class Feed:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0
        (folder / "drops").mkdir()

    def drop(self, *items, more=""):
        self.n += 1
        (self.folder / "drops" / f"{self.n}.json").write_text("\n".join(map(json.dumps, items)) + "\n" + more)

    def run(self, **how):
        ingest(self.spark, str(self.folder / "drops"), str(self.folder / "out"), str(self.folder / "at"), **how)
        return sorted(r.item_pos for r in self.spark.read.parquet(str(self.folder / "out")).collect())


def test_stream_takes_items_once(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.drop(*map(item, (1, 2, 2, 3)), more="not json\n")
    assert feed.run() == [1, 2, 3] and feed.run() == [1, 2, 3]
    feed.drop(item(3), item(4))
    assert feed.run() == [1, 2, 3, 4]
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.image_url for r in rows} == {"a.png"} and {r.category for r in rows} == {"sports"}


def test_stream_keeps_what_the_quota_defers(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.drop(*map(item, range(30)))
    assert feed.run(per_category=20) == list(range(20))
    feed.drop(*map(item, range(28, 35)))
    assert feed.run(per_category=12) == list(range(32))  # those that waited come first
    assert feed.run(per_category=2) == list(range(34)) and feed.run() == list(range(35)) and feed.run() == list(range(35))  # without new drops


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.drop(*map(item, range(5)))
    feed.run(per_category=2)
    feed.drop(item(9))
    feed.run(per_category=2)
    last = max(p for p in (tmp_path / "at" / "commits").iterdir() if p.name.isdigit())
    (last.parent / f".{last.name}.crc").unlink()
    last.unlink()  # as if the run had died before its commit
    assert feed.run(per_category=2) == [0, 1, 2, 3] and feed.run() == [0, 1, 2, 3, 4, 9]


def test_stream_looks_back(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    same = " ".join(f"common{i}" for i in range(20))
    feed.drop(item(1, body=same), item(2, body=same + " other"), item(3))
    assert feed.run(as_of=datetime(2024, 1, 1)) == [1, 3]
    feed.drop(item(4, body=same + " late"), item(5))
    assert feed.run(as_of=datetime(2024, 1, 7)) == [1, 3, 5]
    feed.drop(item(6, body=same + " later"))
    assert feed.run(as_of=datetime(2024, 1, 9)) == [1, 3, 5, 6]


def test_stream_sources_and_scan(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.drop(item(1), item(2), item(3), item(4, source="off"))
    sources = spark.createDataFrame([("s", True), ("off", False)], "id string, is_active boolean")
    assert feed.run(scan=2, sources=sources) == [1, 2]


def test_rolling_inventory_streams_as_it_counts_tables(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = rolling_inventory(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "event_type")
    q = stream.writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("rolled").collect())) == sorted(map(tuple, rolling_inventory(events, "event_type").collect()))


def test_faults_are_kept_and_dead_sources_skipped(spark, tmp_path):
    from newsloom.streaming.feeds import dead_sources, revive, source_states

    feed, out = Feed(spark, tmp_path), str(tmp_path / "out")
    bad = {"source_id": "gone", "error": "getaddrinfo ENOTFOUND feeds.example", "item_pos": 0}
    slow = {"source_id": "slow", "error": "timeout of 8000ms", "item_pos": 0}
    feed.drop(item(1), item(2, source="slow"), bad, slow, {"source_id": "s", "content": "x", "item_pos": 3}, more='{"title": "half\n')
    assert feed.run(as_of=datetime(2024, 1, 1)) == [1, 2]
    held = {(r.source_id, r.fault, r.line) for r in spark.read.parquet(f"{out}-quarantine").collect()}
    assert {(s, f) for s, f, _ in held} == {("gone", "fetch failed: " + bad["error"]), ("slow", "fetch failed: timeout of 8000ms"), ("s", "neither title nor link"), (None, "not an item in JSON")}
    assert '{"title": "half' in {line for _, _, line in held}
    states = {r.source_id: (r.last_fetched_at, r.n_items, r.n_faults, r.last_error, r.is_dead) for r in source_states(spark, out).collect()}
    assert states == {"s": (datetime(2024, 1, 1), 1, 1, None, False), "slow": (datetime(2024, 1, 1), 1, 1, slow["error"], False), "gone": (None, 0, 1, bad["error"], True)}
    feed.drop(item(5, source="gone"), item(6, source="slow"))
    assert feed.run(as_of=datetime(2024, 1, 2)) == [1, 2, 6] and [r.source_id for r in dead_sources(spark, out).collect()] == ["gone"]
    assert spark.read.parquet(f"{out}-quarantine").where("fault = 'source is off'").count() == 1
    assert {r.source_id: r.last_fetched_at for r in source_states(spark, out).collect()} == {"s": datetime(2024, 1, 1), "slow": datetime(2024, 1, 2), "gone": None}
    revive(spark, out, "gone")
    feed.drop(item(7, source="gone"))
    assert feed.run(as_of=datetime(2024, 1, 3)) == [1, 2, 6, 7] and dead_sources(spark, out).count() == 0
