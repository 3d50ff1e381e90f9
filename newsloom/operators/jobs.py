"""
Publish jobs over time. A job waits as QUEUED, is RUNNING, and ends as SUCCESS or in the dead letters; what happened to it
is told by events in order of time:

started  the job runs; without an outcome after `run_limit` seconds it counts as thrown
sent     SUCCESS
refused  FAILED; the platform said no, so no attempt is counted
threw    an attempt is counted: the last of `most` ends as DEAD_LETTERED, others as FAILED, and the job waits `wait` seconds,
         twice as long each time, until it is QUEUED again
retry    by hand: QUEUED, with no attempts counted, whatever the job was

Events of a finished job and attempts at one that still waits change nothing. Events of one time follow by their `seq`.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND = 1_000_000
FINAL = ("SUCCESS", "DEAD_LETTERED")


class Rules(NamedTuple):
    most: int = 3
    wait: int = 5
    run_limit: int = 600


class Job(NamedTuple):
    """`due`: when the state ends by itself, in microseconds."""

    status: str = "QUEUED"
    retries: int = 0
    due: int | None = None


def thrown(job: Job, t: int, rules: Rules) -> Job:
    tries = job.retries + 1
    return Job("DEAD_LETTERED", tries) if tries >= rules.most else Job("FAILED", tries, t + rules.wait * SECOND * 2**tries)


def elapsed(job: Job, t: int, rules: Rules) -> Job:
    """What time alone has done by t."""
    if job.status == "RUNNING" and job.due is not None and job.due <= t:
        job = thrown(job, job.due, rules)
    return Job("QUEUED", job.retries) if job.status == "FAILED" and job.due is not None and job.due <= t else job


def after(job: Job, t: int, kind: str, rules: Rules) -> Job:
    """The job once an event has come."""
    job = elapsed(job, t, rules)
    if kind == "retry":
        return Job()
    if job.status in FINAL or (job.status == "FAILED" and job.due is not None):
        return job
    if kind == "threw":
        return thrown(job, t, rules)
    return {"started": Job("RUNNING", job.retries, t + rules.run_limit * SECOND), "sent": Job("SUCCESS", job.retries), "refused": Job("FAILED", job.retries)}.get(kind, job)


STATE = "struct<status:string,retries:int,due:bigint>"
LOG = "array<struct<t:bigint,seq:bigint,kind:string>>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _job(status, retries: Column, due: Column | None = None) -> Column:
    return F.struct((status if isinstance(status, Column) else F.lit(status)).alias("status"), retries.cast("int").alias("retries"), (F.lit(None) if due is None else due).cast("long").alias("due"))


def _thrown(job: Column, t: Column, rules: Rules) -> Column:
    tries = job["retries"] + 1
    return F.when(tries >= rules.most, _job("DEAD_LETTERED", tries)).otherwise(_job("FAILED", tries, t + F.shiftleft(F.lit(rules.wait * SECOND), 1) * F.pow(F.lit(2), job["retries"]).cast("long")))


def _elapsed(job: Column, t: Column, rules: Rules) -> Column:
    ran = F.when((job["status"] == "RUNNING") & (job["due"] <= t), _thrown(job, job["due"], rules)).otherwise(job)
    return _let(ran, lambda j: F.when((j["status"] == "FAILED") & (j["due"] <= t), _job("QUEUED", j["retries"])).otherwise(j))


def folded(job: Column, log: Column, rules: Rules, until: Column | None = None) -> Column:
    """The state `job` (null: a new one) after the events of `log`, an array in their order, and after what time alone did up to `until` (microseconds)."""

    def step(job: Column, e: Column) -> Column:
        def come(j: Column) -> Column:
            kind, t = e["kind"], e["t"]
            closed = j["status"].isin(*FINAL) | ((j["status"] == "FAILED") & j["due"].isNotNull())
            return (
                F.when(kind == "retry", _job("QUEUED", F.lit(0)))
                .when(closed, j)
                .when(kind == "threw", _thrown(j, t, rules))
                .when(kind == "started", _job("RUNNING", j["retries"], t + rules.run_limit * SECOND))
                .when(kind == "sent", _job("SUCCESS", j["retries"]))
                .when(kind == "refused", _job("FAILED", j["retries"]))
                .otherwise(j)
            )

        return _let(_elapsed(job, e["t"], rules), come)

    done = F.aggregate(log, F.coalesce(job, _job("QUEUED", F.lit(0)).cast(STATE)), step)
    return done if until is None else _let(done, lambda j: _elapsed(j, until, rules))


def job_states(events: DataFrame, keys: list[str], rules: Rules = Rules(), until: Column | None = None) -> DataFrame:
    """
    keys, status, retries, due: each job after all of its events, and after what time alone did up to `until`. `events`: keys,
    at (timestamp), seq, kind. A job's events, as few as its attempts, are folded in its row.
    """
    of_job = F.array_sort(F.collect_list(F.struct(F.unix_micros("at").alias("t"), F.col("seq").cast("long").alias("seq"), "kind")))
    rows = events.where(F.col("at").isNotNull() & F.col("kind").isNotNull()).groupBy(*keys).agg(of_job.alias("e"))
    job = folded(F.lit(None).cast(STATE), F.col("e"), rules, None if until is None else F.unix_micros(until.cast("timestamp")))
    return rows.select(*keys, job.alias("job")).select(*keys, "job.status", "job.retries", F.timestamp_micros("job.due").alias("due"))
