"""Structured Streaming: incremental ingestion that takes each item once and keeps what a quota defers, and rolling inventory."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import is_dead_source
from newsloom.operators.lookback import LookBack
from newsloom.operators.relational import first_by_key
from newsloom.operators.seen import SeenKeys
from newsloom.operators.similarity import accepted
from newsloom.operators.storage import deleted, discard, exists, folders, stored
from newsloom.sources.tables import BROKEN, feed_items, feed_lines, ingested

ORDER = ["batch_rank", "source_id", "item_pos", "content_hash"]


def ingest(
    spark: SparkSession, drops: str, target: str, checkpoint: str, per_category: int | None = 20, scan: int | None = None,
    as_of: datetime | None = None, look_back_days: int | None = 7, sources: DataFrame | None = None,
) -> None:
    """
    Takes the drops that came since the last run: of each source's drop the first `scan` items (None: all), of active
    `sources` (id, is_active) only. Items whose hash or link is known go, and items alike to one taken in the last
    `look_back_days` or to an earlier one of this run. Of the rest each run takes `per_category` of each category; what is
    over waits in `<target>-waiting` and comes first in the next run, even if no drop came by then.

    What is no item goes to `<target>-quarantine` with its drop, source and fault. `<target>-sources` says when each source was
    last fetched, its faults so far and its last error. A source whose error says that it is dead is off: what a later batch brings
    of it goes to the quarantine, too, until revive() lets it in again.

    What was taken is kept in a look-back index (`<target>-index`), of which a batch reads `look_back_days` and a day. Its hashes and links
    are kept in folders by key (`<target>-seen`), of which a batch reads those that its own items fall into.

    Each micro-batch writes a folder of its own, named by its number, in all tables. A batch run again writes the same
    folders again, so no item is lost or taken twice.
    """
    done: list[str] = []

    def take(batch: DataFrame, number: int) -> None:
        name, now = f"{number:012d}-0000", as_of or datetime.now()
        lines = stored(batch, "lines")  # read by several sinks
        off = dead_sources(spark, target, name).select(F.col("source_id").alias("off"))
        lines_ = lines.join(F.broadcast(off), F.col("source_id") == F.col("off"), "left")  # a row for each dead source of an editor's list
        lines_ = lines_.withColumn("fault", F.coalesce("fault", F.when(F.col("off").isNotNull(), "source is off"))).drop("off")
        faults = lines_.where("fault IS NOT NULL").select("drop", "source_id", "item_pos", "fault", F.coalesce(BROKEN, F.to_json(F.struct("title", "link", "error"))).alias("line"))
        faults.write.mode("overwrite").parquet(f"{target}-quarantine/batch={name}")
        _note(spark, lines_, target, name, now)
        items = lines_.where("fault IS NULL").drop(BROKEN, "fault", "error")
        _take(batch.sparkSession, _arrived(items, scan, sources), name, target, per_category, now, look_back_days)
        discard(lines)
        done.append(name)

    stream = feed_lines(spark, drops, stream=True).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    stream.start().awaitTermination()
    if not done and (last := _last(spark, f"{target}-waiting")):
        number, again = last.split("-")
        nothing = _arrived(feed_items(spark, drops).limit(0), None, None)
        _take(spark, nothing, f"{number}-{int(again) + 1:04d}", target, per_category, as_of or datetime.now(), look_back_days)


_SOURCE = "source_id string, last_fetched_at timestamp, n_items long, n_faults long, last_error string, is_dead boolean"


def source_states(spark: SparkSession, target: str, before: str | None = None) -> DataFrame:
    """source_id, last_fetched_at, n_items, n_faults, last_error, is_dead, as the last batch left them (or the last before one)."""
    last = _last(spark, f"{target}-sources", before)
    return spark.createDataFrame([], _SOURCE) if last is None else spark.read.schema(_SOURCE).parquet(f"{target}-sources/batch={last}")


def dead_sources(spark: SparkSession, target: str, before: str | None = None) -> DataFrame:
    return source_states(spark, target, before).where("is_dead").select("source_id")


def revive(spark: SparkSession, target: str, source_id: str) -> None:
    """Lets a dead source in again, once an editor has mended its address."""
    last = _last(spark, f"{target}-sources")
    if last is not None:
        number, again = last.split("-")
        rows = source_states(spark, target).withColumn("is_dead", F.col("is_dead") & (F.col("source_id") != source_id))
        rows.write.mode("overwrite").parquet(f"{target}-sources/batch={number}-{int(again) + 1:04d}")


def _note(spark: SparkSession, lines: DataFrame, target: str, name: str, now: datetime) -> None:
    """The sources' next states: one row for each source, from those of the batch before and this batch's lines."""
    item, error = F.col("fault").isNull(), F.col("error").isNotNull()
    own = lines.where(F.col("source_id").isNotNull() & ~F.coalesce(F.col("fault") == "source is off", F.lit(False))).groupBy("source_id").agg(
        F.max(F.when(item, F.lit(now).cast("timestamp"))).alias("last_fetched_at"), F.count_if(item).alias("n_items"), F.count_if(~item).alias("n_faults"),
        F.max(F.when(error, F.col("error"))).alias("last_error"), F.coalesce(F.bool_or(error & is_dead_source(F.col("error"))), F.lit(False)).alias("is_dead"),
    )
    both = source_states(spark, target, name).withColumn("is_new", F.lit(0)).unionByName(own.withColumn("is_new", F.lit(1)))
    last = F.max_by("last_error", F.when(F.col("last_error").isNotNull(), F.col("is_new")))
    states = both.groupBy("source_id").agg(F.max("last_fetched_at").alias("last_fetched_at"), F.sum("n_items").alias("n_items"), F.sum("n_faults").alias("n_faults"), last.alias("last_error"), F.bool_or("is_dead").alias("is_dead"))
    states.write.mode("overwrite").parquet(f"{target}-sources/batch={name}")


def _arrived(items: DataFrame, scan: int | None, sources: DataFrame | None) -> DataFrame:
    if sources is not None:
        items = items.join(sources.where("is_active").select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return ingested(first_by_key(items, ["source_id", "drop"], ["item_pos"], scan) if scan else items).withColumn("batch_rank", F.lit(1))


def _last(spark: SparkSession, table: str, before: str | None = None) -> str | None:
    """The last of a table's finished folders, of those before `before`."""
    names = [n.removeprefix("batch=") for n in folders(spark, table) if n.startswith("batch=")]
    return max((n for n in names if (before is None or n < before) and exists(spark, f"{table}/batch={n}/_SUCCESS")), default=None)


def _take(spark: SparkSession, items: DataFrame, name: str, target: str, per_category: int | None, at: datetime, look_back_days: int | None) -> None:
    waiting = f"{target}-waiting"
    if (before := _last(spark, waiting, name)) is not None:
        items = items.unionByName(spark.read.schema(items.schema).parquet(f"{waiting}/batch={before}").withColumn("batch_rank", F.lit(0)))
    fresh = first_by_key(items, ["content_hash"], ORDER)
    fresh = first_by_key(fresh, ["source_url"], ORDER)
    arrived = stored(fresh, "arrived")
    seen = {key: SeenKeys(spark, f"{target}-seen/{key}") for key in ("content_hash", "source_url")}
    fresh = arrived
    for key, table in seen.items():
        fresh = fresh.join(table.near(arrived, key, name), key, "left_anti")
    fresh = stored(fresh.orderBy(*ORDER).withColumn("at", F.monotonically_increasing_id()), "fresh")
    used = [arrived, fresh]
    now = F.lit(at).cast("timestamp")
    index = LookBack(spark, f"{target}-index", look_back_days) if look_back_days is not None else None
    if index:
        repeats = index.repeated(fresh.select("at", F.col("body").alias("text")).withColumnRenamed("at", "place").withColumn("at", now), "place", without=name, ties=True)
        new = stored(fresh.join(repeats.where("NOT is_repeat").select(F.col("place").alias("at")), "at", "left_semi"), "fresh")
        kept = accepted(new.select(F.col("at").alias("doc_id"), F.col("body").alias("text"))).where("is_accepted").select(F.col("doc_id").alias("at"))
        fresh = stored(new.join(kept, "at", "left_semi"), "fresh")
        used += [new, fresh]
    chosen = stored(fresh if per_category is None else first_by_key(fresh, ["category"], ["at"], per_category), "chosen")
    if index:
        index.add(chosen.select(now.alias("at"), F.col("body").alias("text")), name)
        index.expire((at - timedelta(days=look_back_days + 1)).date())
    for key, table in seen.items():
        table.add(chosen, key, name)
    chosen.drop("at", "batch_rank").withColumn("fetched_at", now).write.mode("overwrite").parquet(f"{target}/batch={name}")
    fresh.join(chosen.select("at"), "at", "left_anti").drop("at").write.mode("overwrite").parquet(f"{waiting}/batch={name}")
    discard(*used, chosen)
    while before is not None and (old := _last(spark, waiting, before)) is not None:  # the one before stays, in case this batch runs again
        deleted(spark, f"{waiting}/batch={old}")


def rolling_inventory(events: DataFrame, by: str, width: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """
    Counts by sliding window; works on streams (with a watermark) and tables alike. On a table rows are counted by slide
    first, so that counts are copied to the windows they fall into and not rows.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need times with a zone
    if rows.isStreaming:
        return rows.withWatermark("ts", late).groupBy(F.window("ts", width, slide), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), by, "n")
    counts = rows.groupBy(F.window("ts", slide).alias("slot"), by).agg(F.count("*").alias("n"))
    start, step = F.col("slot.start"), F.expr(f"INTERVAL {slide}")
    windows = F.explode(F.sequence(start - F.expr(f"INTERVAL {width}") + step, start, step))
    return counts.select(windows.alias("window_start"), by, "n").groupBy("window_start", by).agg(F.sum("n").alias("n"))
