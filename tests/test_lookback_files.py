"""How many files the look-back index writes, and what a lookup pairs."""

from datetime import datetime, timedelta

from newsloom.operators import lookback
from newsloom.operators.lookback import LookBack

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, at timestamp, text string"


def test_a_day_of_a_batch_is_one_file(spark, tmp_path):
    # as where partitions are too large to be put together, or to be broadcast
    large = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in large}
    for k, v in large.items():
        spark.conf.set(k, v)
    try:
        rows = [(k, T0 + timedelta(hours=k % 240), " ".join(f"subject{k % 700}word{i}" for i in range(12))) for k in range(1200)]
        LookBack(spark, str(tmp_path / "index")).add(spark.createDataFrame(rows, SCHEMA), "000")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name in ("classes", "postings"):
        assert [len(list(d.rglob("*.parquet"))) for d in (tmp_path / "index" / name).iterdir() if d.name.startswith("day=")] == [1] * 10


def test_texts_of_the_index_are_not_paired_with_each_other(spark, tmp_path, monkeypatch):
    counts, own = {}, lookback.stored

    def counted(df, name, **options):
        out = own(df, name, **options)
        counts[name] = out.count()
        return out

    words = " ".join(f"subject{i}" for i in range(30))
    index = LookBack(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame([(k, T0 + timedelta(hours=k), f"{words} changed{k}") for k in range(40)], SCHEMA), "000")
    monkeypatch.setattr(lookback, "stored", counted)
    asked = [(1, T0 + timedelta(days=2), words), (2, T0 + timedelta(days=2), words + " other-one"), (3, T0 + timedelta(days=2), "nothing like them"), (4, T0 + timedelta(days=20), words)]
    got = sorted(map(tuple, index.repeated(spark.createDataFrame(asked, SCHEMA), "id").collect()))
    assert got == [(1, True), (2, True), (3, False), (4, False)] and counts["pairs"] == 80


def test_rows_cut_to_tokens_once_give_the_same(spark, tmp_path):
    rows = spark.createDataFrame([(k, T0 + timedelta(days=k), " ".join(f"subject{k % 3}word{i}" for i in range(12 + k))) for k in range(12)] + [(12, None, "some words"), (13, T0, None)], SCHEMA)
    found = []
    for name, asked in (("a", rows), ("b", LookBack(spark, "").keyed(rows, "id"))):
        index = LookBack(spark, str(tmp_path / name))
        index.add(asked, "000")
        found.append(sorted(map(tuple, index.repeated(asked, "id").collect())))
    assert found[0] == found[1] and len(found[0]) == 14 and any(r for _, r in found[0])
