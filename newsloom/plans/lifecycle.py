"""Table versions, publishing jobs, transitions and approvals."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions import text as T
from newsloom.operators.relational import after_attempt, updated, upserted, without_keys
from newsloom.sources.tables import table

from .crosswalk import articles, day, jobs
from .registry import query


@query("k3_point_update", "SELECT o_orderkey AS id, CASE WHEN o_orderkey = 5 THEN 'X' ELSE o_orderstatus END AS status FROM orders")
def point_update(spark, sf):
    return updated(articles(spark, sf), F.col("id") == 5, status="X").select("id", "status")


@query("k4_bulk_update", "SELECT event_id, (event_type = 'view' AND user_id = 8) AS is_read FROM events")
def bulk_update(spark, sf):
    e = table(spark, sf, "events").withColumn("is_read", F.lit(False))
    return updated(e, (F.col("user_id") == 8) & (F.col("event_type") == "view"), is_read=True).select("event_id", "is_read")


@query("k5_upsert", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey * 20 - 7 FROM supplier) UNION ALL SELECT s_suppkey * 20 - 7, s_name FROM supplier")
def upsert(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = table(spark, sf, "supplier").select((F.col("s_suppkey") * 20 - 7).alias("id"), F.col("s_name").alias("name"))
    return upserted(old, new, "id")


@query("k5_insert_absent", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey * 20 - 7, s_name FROM supplier WHERE s_suppkey * 20 - 7 NOT IN (SELECT c_custkey FROM customer)")
def insert_absent(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = table(spark, sf, "supplier").select((F.col("s_suppkey") * 20 - 7).alias("id"), F.col("s_name").alias("name"))
    return upserted(old, new, "id", update=False)


@query("k6_delete", "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)")
def delete(spark, sf):
    gone = jobs(spark, sf).where("status = 'R' AND quantity > 40").select(F.col("tag_id").alias("id"))
    return without_keys(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), gone, "id")


@query("k7_soft_delete", "SELECT c_custkey AS id, NOT c_acctbal < 0 AS is_active FROM customer")
def soft_delete(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", F.lit(True).alias("is_active"))
    return updated(c, F.col("c_acctbal") < 0, is_active=False).select("id", "is_active")


@query("k9_version_append", "SELECT conv_id, max(turn) AS current_turn, count(*) AS n_versions FROM (SELECT conv_id, turn FROM conversations UNION ALL SELECT conv_id, max(turn) + 1 FROM conversations GROUP BY conv_id) GROUP BY conv_id")
def version_append(spark, sf):
    old = table(spark, sf, "conversations").select("conv_id", "turn")
    new = old.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"))
    return old.unionByName(new).groupBy("conv_id").agg(F.max("turn").alias("current_turn"), F.count("*").alias("n_versions"))


@query("k11_audit_rows", "SELECT event_id, upper(event_type) AS action FROM events WHERE event_type IN ('purchase', 'signup')")
def audit_rows(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type").isin("purchase", "signup")).select("event_id", F.upper("event_type").alias("action"))


@query("k17_validation", "SELECT c_custkey AS id, c_acctbal >= 0 AND length(c_name) >= 8 AND c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY') AND regexp_full_match(c_name, 'Customer#[0-9]{9}') AS valid FROM customer")
def validation(spark, sf):
    c = table(spark, sf, "customer")
    ok = (F.col("c_acctbal") >= 0) & (F.length("c_name") >= 8) & F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY") & F.col("c_name").rlike("^Customer#[0-9]{9}$")
    return c.select(F.col("c_custkey").alias("id"), ok.alias("valid"))


@query("m6_retry_escalation", """
SELECT l_orderkey AS article_id, l_linenumber AS number, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber % 4 + 1 >= 3 THEN 'DEAD_LETTERED' ELSE 'FAILED' END WHEN l_returnflag = 'N' THEN 'SUCCESS' ELSE 'FAILED' END AS status,
  (l_linenumber % 4 + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::INT AS retries FROM lineitem""")
def retry_escalation(spark, sf):
    j = jobs(spark, sf).withColumn("retries", (F.col("number") % 4).cast("int")).withColumn("outcome", F.col("status"))
    return after_attempt(j, F.col("outcome") == "R", F.col("outcome") == "N").select("article_id", "number", "status", "retries")


_STATES = list(T.TRANSITIONS)
_SQL_STATES = "[" + ", ".join(f"'{s}'" for s in _STATES) + "]"
_SQL_MOVES = "[" + ", ".join(f"'{a}>{b}'" for a, to in T.TRANSITIONS.items() for b in to) + "]"


def _moves(spark, sf):
    states = F.array(*map(F.lit, _STATES))
    at = lambda c, k: F.element_at(states, (F.pmod(F.floor(F.col(c) / k), F.lit(10)) + 1).cast("int"))
    return articles(spark, sf).select("id", "published_at", at("id", 1).alias("old"), at("id", 10).alias("new"))


@query("m7_transition_valid", f"SELECT id, old, new, list_contains({_SQL_MOVES}, old || '>' || new) AS valid FROM (SELECT o_orderkey AS id, {_SQL_STATES}[(o_orderkey % 10 + 1)::INT] AS old, {_SQL_STATES}[(o_orderkey // 10 % 10 + 1)::INT] AS new FROM orders)")
def transition_valid(spark, sf):
    return _moves(spark, sf).select("id", "old", "new", T.is_transition(F.col("old"), F.col("new")).alias("valid"))


@query("m8_transition_effects", f"SELECT id, CASE WHEN new = 'PUBLISHED' AND old = 'PUBLISHING' THEN '2001-08-02' ELSE strftime(ts, '%Y-%m-%d') END AS published FROM (SELECT o_orderkey AS id, o_orderdate AS ts, {_SQL_STATES}[(o_orderkey % 10 + 1)::INT] AS old, {_SQL_STATES}[(o_orderkey // 10 % 10 + 1)::INT] AS new FROM orders)")
def transition_effects(spark, sf):
    moved = T.is_transition(F.col("old"), F.col("new")) & (F.col("new") == "PUBLISHED")
    return _moves(spark, sf).select("id", F.when(moved, "2001-08-02").otherwise(day("published_at")).alias("published"))


@query("m2_risk_bucket", "SELECT d.doc_id, CASE WHEN coalesce(s, 0) < 0.3 THEN 'low' WHEN s < 0.6 THEN 'medium' ELSE 'high' END AS level FROM documents d LEFT JOIN (SELECT doc_id, (toxic + quality) / 2.0 AS s FROM labels) l USING (doc_id)")
def risk_bucket(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", ((F.col("toxic") + F.col("quality")) / 2).alias("s"))
    return table(spark, sf, "documents").select("doc_id").join(l, "doc_id", "left").select("doc_id", T.risk_level(F.col("s")).alias("level"))


@query("u7_platform_jobs", """
WITH p AS (SELECT l_orderkey AS id, bool_or(l_linestatus = 'O') AS video FROM lineitem GROUP BY l_orderkey)
SELECT id, unnest(CASE WHEN video THEN ['TWITTER', 'TELEGRAM', 'YOUTUBE'] ELSE ['TWITTER', 'TELEGRAM'] END) AS platform FROM p""")
def platform_jobs(spark, sf):
    a = jobs(spark, sf).groupBy(F.col("article_id").alias("id")).agg(F.bool_or(F.col("platform") == "O").alias("video"))
    social, enabled = F.array(F.lit("TWITTER"), F.lit("TELEGRAM"), F.lit("FACEBOOK")), F.array(F.lit("TWITTER"), F.lit("TELEGRAM"), F.lit("YOUTUBE"))
    wanted = F.array_intersect(social, enabled)
    return a.select("id", F.explode(F.when(F.col("video"), F.array_union(wanted, F.array(F.lit("YOUTUBE")))).otherwise(wanted)).alias("platform"))


@query("r4_explode_map", "SELECT event_id, c.platform, c.caption FROM events, LATERAL (VALUES ('TWITTER', event_type), ('TELEGRAM', props)) c(platform, caption)")
def explode_map(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.explode(F.create_map(F.lit("twitter"), "event_type", F.lit("telegram"), "props", F.lit("unknown"), "event_type")).alias("name", "caption"))
    known = spark.createDataFrame([("twitter", "TWITTER"), ("telegram", "TELEGRAM"), ("facebook", "FACEBOOK")], "name string, platform string")
    return e.join(F.broadcast(known), "name").select("event_id", "platform", "caption")  # three rows


@query("r5_json_path", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.none') AS absent FROM events")
def json_path(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.none").alias("absent"))


@query("m4_subtitle_timing", r"""
WITH w AS (SELECT conv_id, turn, greatest(1, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) AS n FROM conversations),
p AS (SELECT conv_id, turn, n, sum(n) OVER (PARTITION BY conv_id) AS words FROM w),
d AS (SELECT conv_id, turn, greatest(1500000, floor(n * 60000000 / words))::BIGINT AS d FROM p),
c AS (SELECT conv_id, turn, d, (sum(d) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS c FROM d)
SELECT conv_id, turn, least(60000000, c - d)::BIGINT AS begins_us, least(60000000, c)::BIGINT AS ends_us FROM c""")
def subtitle_timing(spark, sf, total: int = 60):
    """A line takes its share of the total by words, 1.5 seconds at least; microseconds, so that sums are exact."""
    words = F.greatest(F.lit(1), F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")))
    all_ = Window.partitionBy("conv_id")
    c = table(spark, sf, "conversations").select("conv_id", "turn", words.alias("n"))
    c = c.withColumn("d", F.greatest(F.lit(1_500_000), F.floor(F.col("n").cast("long") * (total * 1_000_000) / F.sum("n").over(all_))).cast("long"))
    c = c.withColumn("c", F.sum("d").over(all_.orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    end = F.lit(total * 1_000_000)
    return c.select("conv_id", "turn", F.least(end, F.col("c") - F.col("d")).cast("long").alias("begins_us"), F.least(end, F.col("c")).cast("long").alias("ends_us"))
