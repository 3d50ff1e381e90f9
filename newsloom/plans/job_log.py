"""Publish jobs over time: an order's line items of one line status are the events of a job."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.operators.jobs import SECOND, Rules, job_states
from newsloom.operators.storage import shared_dir
from newsloom.sources.tables import table

from .crosswalk import AS_OF
from .registry import query

DAY = 86_400
RULES = Rules(most=3, wait=DAY, run_limit=DAY)
KEYS = {"article_id": "long", "platform": "string"}
_KIND = """CASE WHEN l_linenumber = 6 THEN 'retry' WHEN l_linenumber % 3 = 1 THEN 'started'
WHEN l_returnflag = 'N' THEN CASE WHEN l_quantity > 25 THEN 'sent' ELSE 'threw' END ELSE CASE WHEN l_quantity > 10 THEN 'threw' ELSE 'refused' END END"""


def events(lines):
    return lines.select(F.col("l_orderkey").alias("article_id"), F.col("l_linestatus").alias("platform"), F.col("l_shipdate").cast("timestamp").alias("at"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("seq"), F.expr(_KIND).alias("kind"))


def _j(status: str, retries: str, due: str = "NULL") -> str:
    return f"struct_pack(t := 0::BIGINT, seq := 0::BIGINT, kind := '', status := {status}, retries := ({retries})::INT, due := ({due})::BIGINT)"


def _thrown(j: str, t: str) -> str:
    tries = f"{j}.retries + 1"
    return f"CASE WHEN {tries} >= {RULES.most} THEN {_j("'DEAD_LETTERED'", tries)} ELSE {_j("'FAILED'", tries, f'{t} + {RULES.wait * SECOND} * (1 << ({tries}))')} END"


def _elapsed(j: str, t: str) -> str:
    ran = f"CASE WHEN {j}.status = 'RUNNING' AND {j}.due <= {t} THEN {_thrown(j, f'{j}.due')} ELSE {j} END"
    return f"list_transform([{ran}], lambda r: CASE WHEN r.status = 'FAILED' AND r.due <= {t} THEN {_j("'QUEUED'", 'r.retries')} ELSE r END)[1]"


_STEP = f"""list_transform([{_elapsed("a", "e.t")}], lambda j: CASE WHEN e.kind = 'retry' THEN {_j("'QUEUED'", "0")}
WHEN j.status IN ('SUCCESS', 'DEAD_LETTERED') OR (j.status = 'FAILED' AND j.due IS NOT NULL) THEN j WHEN e.kind = 'threw' THEN {_thrown("j", "e.t")}
WHEN e.kind = 'started' THEN {_j("'RUNNING'", "j.retries", f"e.t + {RULES.run_limit * SECOND}")} WHEN e.kind = 'sent' THEN {_j("'SUCCESS'", "j.retries")} ELSE {_j("'FAILED'", "j.retries")} END)[1]"""


def _fold(until: str, where: str = "true") -> str:
    return f"""
WITH ev AS (SELECT l_orderkey AS article_id, l_linestatus AS platform, epoch_us(l_shipdate) AS t, l_linenumber * 1000000 + l_partkey AS seq, {_KIND} AS kind FROM lineitem WHERE {where}),
l AS (SELECT article_id, platform, list(struct_pack(t := t, seq := seq::BIGINT, kind := kind, status := '', retries := 0::INT, due := NULL::BIGINT) ORDER BY t, seq, kind) AS log FROM ev GROUP BY article_id, platform),
f AS (SELECT article_id, platform, list_reduce(list_concat([{_j("'QUEUED'", "0")}], log), lambda a, e: {_STEP}) AS a FROM l),
u AS (SELECT {until} AS until_us),
g AS (SELECT article_id, platform, {_elapsed("f.a", "until_us")} AS j FROM f, u)
SELECT article_id, platform, j.status AS status, j.retries AS retries, j.due AS due_us FROM g"""


def _shown(df):
    return df.select(*KEYS, "status", "retries", F.unix_micros("due").alias("due_us"))


@query("x8_job_states", _fold(f"epoch_us(TIMESTAMP '{AS_OF:%Y-%m-%d}')"))
def job_fold(spark, sf):
    """Each job after all of its events."""
    return _shown(job_states(events(table(spark, sf, "lineitem")), list(KEYS), RULES, F.lit(AS_OF)))


_MARK = "(SELECT max(epoch_us(l_shipdate)) FROM lineitem) - 3600000000"


@query("x8_job_stream", _fold(_MARK, f"epoch_us(l_shipdate) <= {_MARK}"))
def job_stream(spark, sf):
    """The same by a stream over the table's files, up to its watermark: an hour before the last event."""
    from newsloom.streaming.jobs import current_jobs, run_jobs

    # as a pattern the path may be a file or a folder
    path, schema = f"{sf}/lineitem.parque[t]", table(spark, sf, "lineitem").schema
    at = f"{shared_dir(spark)}/newsloom-jobs-{uuid.uuid4().hex}"
    run_jobs(spark, events(spark.readStream.schema(schema).parquet(path)), KEYS, f"{at}/states", f"{at}/checkpoint", RULES)
    return _shown(current_jobs(spark, f"{at}/states", list(KEYS)))
