"""Structured Streaming: publish jobs as states that each micro-batch carries on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.jobs import LOG, STATE, Rules, folded
from newsloom.operators.storage import discard, exists, folders, stored

_MARK = "mark long, most int, wait int, run_limit int"


def _name(number: int) -> str:
    return f"batch={number:012d}"


def _mark(spark: SparkSession, target: str, before: int | None = None) -> Row:
    """The watermark (microseconds) after the last micro-batch, or the last before one, and the rules of its run."""
    at = f"{target}-marks"
    names = [n for n in folders(spark, at) if n.startswith("batch=") and (before is None or n < _name(before)) and exists(spark, f"{at}/{n}/_SUCCESS")]
    return spark.read.schema(_MARK).parquet(f"{at}/{max(names)}").first() if names else Row(mark=None, **Rules()._asdict())


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> list[Column]:
    return [a[k].eqNullSafe(b[k]) for k in keys]


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, job, ahead: what the last micro-batch that a job had events in left of it."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("job", "ahead"), "batch").alias("last"))
    return last.select(*keys, "last.job", "last.ahead")


def _carried_on(rows: DataFrame, keys: list[str], rules: Rules, mark: int | None) -> DataFrame:
    """keys, job, ahead: the events that the watermark has passed are folded into the state, which time may end; the others stay."""
    now = F.lit(mark).cast("long")
    passed = lambda e: F.coalesce(e["t"] <= now, F.lit(False))
    past, rest = F.filter("ahead", passed), F.filter("ahead", lambda e: ~passed(e))
    begun = F.col("job").isNotNull() | (F.size(past) > 0)
    return rows.select(*keys, F.when(begun, folded(F.col("job"), F.array_sort(past), rules, now)).alias("job"), rest.alias("ahead"))


def run_jobs(spark: SparkSession, events: DataFrame, keys: dict[str, str], target: str, checkpoint: str, rules: Rules = Rules(), late: str = "1 hour") -> None:
    """
    Takes what came to the stream `events` (keys, at, seq, kind) since the last run. `keys`: names and types. An event counts once the
    watermark, `late` behind the latest event, has passed it, so states don't depend on how events were dealt to micro-batches; what
    comes behind the watermark of an earlier micro-batch is left out. Those that count are folded at once, those ahead of it
    wait in the job's row; what time alone does to a job is worked out when it is next looked at.

    A micro-batch writes the jobs that it has events of to a folder of `target`, and the watermark to one of `<target>-marks`, both named by
    its number, so a batch run again writes the same again. It looks for its jobs among the rows of earlier batches.
    """
    names = list(keys)

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        was = _mark(session, target, number).mark
        top = batch.agg(F.unix_micros(F.max("at") - F.expr(f"INTERVAL {late}")).alias("mark")).first().mark
        mark = max((m for m in (was, top) if m is not None), default=None)
        fresh = batch.select(*names, F.struct(F.unix_micros("at").alias("t"), F.col("seq").cast("long").alias("seq"), "kind").alias("e"))
        fresh = fresh if was is None else fresh.where(F.col("e.t") > was)
        came = fresh.groupBy(*names).agg(F.collect_list("e").cast(LOG).alias("came"))
        earlier = [n for n in folders(session, target) if n.startswith("batch=") and n < _name(number)]
        if earlier:
            came = stored(came, "came")  # read twice
            had = session.read.option("basePath", target).parquet(*[f"{target}/{n}" for n in earlier])
            mine = _last(had.join(came, _same(had, came, names), "left_semi"), names)
            jobs = came.join(mine, _same(came, mine, names), "left").select(*[came[k] for k in names], "job", F.concat(F.coalesce("ahead", F.array().cast(LOG)), "came").alias("ahead"))
        else:
            jobs = came.select(*names, F.lit(None).cast(STATE).alias("job"), F.col("came").alias("ahead"))
        _carried_on(jobs, names, rules, mark).write.mode("overwrite").parquet(f"{target}/{_name(number)}")
        session.createDataFrame([(mark, *rules)], _MARK).coalesce(1).write.mode("overwrite").parquet(f"{target}-marks/{_name(number)}")
        if earlier:
            discard(came)

    rows = events.select(*[F.col(k).cast(kind).alias(k) for k, kind in keys.items()], F.col("at").cast("timestamp").alias("at"), "seq", "kind").where("at IS NOT NULL AND kind IS NOT NULL")
    rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current_jobs(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """Each job of which the watermark has passed an event, as it is at the watermark."""
    mark, *rules = _mark(spark, target)
    now = _carried_on(_last(spark.read.option("basePath", target).parquet(target), keys), keys, Rules(*rules), mark)
    return now.where("job IS NOT NULL").select(*keys, "job.status", "job.retries", F.timestamp_micros("job.due").alias("due"))
