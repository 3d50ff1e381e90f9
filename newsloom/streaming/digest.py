"""Structured Streaming: digests of what was not posted yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.relational import first_by_key
from newsloom.operators.storage import deleted, exists, folders

SECOND = 1_000_000
_MARKS = "article long, post long, mark long"


def digest_times(at: Column, hours: int, every: int) -> Column:
    """Of the times at which a digest is made, every `every` hours, those at most `hours` after `at`, ascending; null where there is none."""
    us, step = F.unix_micros(at.cast("timestamp")), every * 3600 * SECOND
    first, last = F.ceil(us / step), F.floor((us + hours * 3600 * SECOND) / step)
    return F.when(last >= first, F.transform(F.sequence(first, last), lambda k: F.timestamp_micros(k * F.lit(step))))


def _batches(spark: SparkSession, at: str, before: str | None = None) -> list[str]:
    return sorted(n for n in folders(spark, at) if n.startswith("batch=") and (before is None or n < before) and exists(spark, f"{at}/{n}/_SUCCESS"))


def run_digests(spark: SparkSession, articles: DataFrame, posts: DataFrame, target: str, checkpoint: str, hours: int = 9, every: int = 3, late: str = "1 hour") -> None:
    """
    Takes what came to the streams `articles` (id, published_at) and `posts` (article_id, posted_at) since the last run. Each article is a
    candidate of the digests in the `hours` after it; a post from those hours before a digest and up to it takes the article out. What is left
    when the watermark passes a digest is appended to `target` (digest_at, id, published_at), so posts may come after the digest's time by
    `late`, in any micro-batch. Rows without a time or an id are left out. The watermark is `late` behind the latest digest that an article is a
    candidate of or the latest post, whichever is earlier; what comes behind that of an earlier micro-batch is left out.

    A micro-batch joins what closes with the posts, and hands on what lies within `hours` of the watermark or ahead of it, in tables
    beside `target`. All are folders named by its number, and those of the batch before stay, so a batch run again writes the same.
    """
    a = articles.select("id", F.col("published_at").cast("timestamp").alias("published_at")).where("id IS NOT NULL AND published_at IS NOT NULL")
    a = a.select(F.lit(False).alias("is_post"), "id", F.explode(digest_times(F.col("published_at"), hours, every)).alias("at"), "published_at")
    p = posts.select(F.lit(True).alias("is_post"), F.col("article_id").alias("id"), F.col("posted_at").cast("timestamp").alias("at"), F.lit(None).cast("timestamp").alias("published_at")).where("id IS NOT NULL AND at IS NOT NULL")
    span, marks, open_ = F.expr(f"INTERVAL {hours} HOURS"), f"{target}-marks", f"{target}-open"
    behind = spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {late}"))).first()[0]

    def put(batch: DataFrame, number: int) -> None:
        session, name = batch.sparkSession, f"batch={number:012d}"
        last = next(iter(reversed(_batches(session, marks, name))), None)
        old = Row(article=None, post=None, mark=None) if last is None else session.read.schema(_MARKS).parquet(f"{marks}/{last}").first()
        top = batch.agg(F.unix_micros(F.max(F.when(~F.col("is_post"), F.col("at")))).alias("article"), F.unix_micros(F.max(F.when(F.col("is_post"), F.col("at")))).alias("post")).first()
        latest = [max((t for t in two if t is not None), default=None) for two in ((old.article, top.article), (old.post, top.post))]
        reached = [] if None in latest else [min(latest) - behind]
        mark = max(reached + [m for m in (old.mark,) if m is not None], default=None)
        now = F.timestamp_micros(F.lit(mark).cast("long"))
        rows = batch if old.mark is None else batch.where(F.unix_micros("at") > old.mark)
        if last is not None:
            rows = rows.unionByName(session.read.schema(rows.schema).parquet(f"{open_}/{last}"))
        closed = rows.where(~F.col("is_post") & (F.col("at") <= now)).select(F.col("at").alias("digest_at"), "id", "published_at")
        known = rows.where("is_post").select(F.col("id").alias("article_id"), F.col("at").alias("posted_at"))
        posted = (F.col("id") == F.col("article_id")) & (F.col("posted_at") <= F.col("digest_at")) & (F.col("posted_at") >= F.col("digest_at") - span)
        closed.join(known, posted, "left_anti").write.mode("overwrite").parquet(f"{target}/{name}")
        gone = F.coalesce(F.when(F.col("is_post"), F.col("at") + span).otherwise(F.col("at")) <= now, F.lit(False))
        rows.where(~gone).write.mode("overwrite").parquet(f"{open_}/{name}")
        session.createDataFrame([(*latest, mark)], _MARKS).coalesce(1).write.mode("overwrite").parquet(f"{marks}/{name}")
        for at in (open_, marks):
            for older in _batches(session, at, name)[:-1]:
                deleted(session, f"{at}/{older}")

    a.unionByName(p).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def digests(spark: SparkSession, target: str, most: int = 5) -> DataFrame:
    """digest_at, id, place: the newest `most` of each digest that is closed."""
    rows = spark.read.schema("digest_at timestamp, id long, published_at timestamp").parquet(target)
    return first_by_key(rows, ["digest_at"], [F.desc("published_at"), "id"], most, "place").select("digest_at", "id", "place")
