"""The look-back index against the look-back over whole tables, and what a batch reads."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from newsloom.operators import lookback
from newsloom.operators.lookback import LookBack
from newsloom.operators.similarity import recent_duplicates
from newsloom.sources.tables import table

from .test_engine import SF

T0 = datetime(2024, 1, 1)


def test_batches_find_what_the_whole_table_shows(spark, tmp_path):
    docs = table(spark, SF, "documents").select("doc_id", "text", F.timestamp_add("HOUR", (F.col("doc_id") * 7 % 199) * 3, F.lit(T0)).alias("ts")).cache()
    want = {r.doc_id for r in recent_duplicates(docs).collect() if r.is_duplicate}
    index, got, rows = LookBack(spark, str(tmp_path / "index")), set(), 0
    for k in range(5):
        part = docs.where(F.col("ts").between(T0 + timedelta(5 * k), T0 + timedelta(5 * k + 5) - timedelta(seconds=1))).withColumnRenamed("ts", "at")
        for _ in range(2 if k == 1 else 1):  # a batch that runs again
            index.add(part, f"{k:03d}")
        found = index.repeated(part, "doc_id").collect()
        rows += len(found)
        got |= {r.doc_id for r in found if r.is_repeat}
        index.expire(date(2024, 1, 1) + timedelta(5 * k - 3))
    assert rows == docs.count() and got == want and len(want) > 10
    assert min(p.name for p in (tmp_path / "index" / "postings").iterdir() if p.name.startswith("day=")) == "day=2024-01-18"


def test_a_batch_reads_eight_days(spark, tmp_path):
    text = lambda k: " ".join(f"subject{k}word{i}" for i in range(12))
    index = LookBack(spark, str(tmp_path / "index"))
    days = [(k, T0 + timedelta(days=k), text(k % 9)) for k in range(30)]
    index.add(spark.createDataFrame(days, "id long, at timestamp, text string"), "000")
    assert len(index._read("postings", date(2024, 1, 23) - timedelta(7), date(2024, 1, 23)).inputFiles()) == 8
    asked = [(1, T0 + timedelta(days=30), text(5)), (2, T0 + timedelta(days=30), text(22 % 9)), (3, None, text(5)), (4, T0 + timedelta(days=30), None), (4, T0 + timedelta(days=30), text(29 % 9).upper())]
    got = sorted(map(tuple, index.repeated(spark.createDataFrame(asked, "id long, at timestamp, text string"), "id").collect()))
    # text 5 came on day 23, exactly 7 days before; text 4 on days 13 and 22, a day too early; text 2 on day 29
    assert got == [(1, True), (2, False), (3, False), (4, False), (4, True)]
    assert index.repeated(spark.createDataFrame([], "id long, at timestamp, text string"), "id").collect() == []
    assert not any(r.is_repeat for r in index.repeated(spark.createDataFrame(asked, "id long, at timestamp, text string"), "id", without="000").collect())


def test_texts_of_other_weeks_are_not_paired(spark, tmp_path, monkeypatch):
    counts, own = {}, lookback.stored

    def counted(df, name, **options):
        out = own(df, name, **options)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(lookback, "stored", counted)
    words = [f"subject{i}" for i in range(20)]
    days = [(k, T0 + timedelta(days=10 * k), " ".join(words + [f"changed{k}"])) for k in range(12)] + [(50, T0 + timedelta(days=3), " ".join(words))]
    rows, index = spark.createDataFrame(days, "id long, at timestamp, text string"), LookBack(spark, str(tmp_path / "index"))
    index.add(rows, "000")
    got = {r.id for r in index.repeated(rows, "id").collect() if r.is_repeat}
    # day 10 looks back to day 3, and that to day 0
    assert got == {50, 1} and counts["pairs"] == 2
