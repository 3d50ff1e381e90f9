"""Counts and health: overview, content inventory, stale sources, status counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from newsloom.operators.relational import dense_counts, where_given
from newsloom.sources.tables import table

from .crosswalk import AS_OF, EVENTS_AS_OF, articles, categorised, categories, day, jobs, moment, users
from .registry import query

LANGUAGES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def languages(spark):
    return spark.createDataFrame([(x,) for x in LANGUAGES], "language string")


@query("a1_overview_counts", """
SELECT (SELECT count(*) FROM orders) AS total_articles, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS published,
  (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS failed_jobs,
  (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS active_sources""")
def overview(spark, sf):
    a = articles(spark, sf).agg(F.count("*").alias("total_articles"), F.count_if(F.col("status") == "F").alias("published"), F.count_if(F.col("status") == "P").alias("pending"))
    j = jobs(spark, sf).agg(F.count_if(F.col("status") == "R").alias("failed_jobs"))
    s = table(spark, sf, "supplier").agg(F.count_if(F.col("s_acctbal") > 0).alias("active_sources"))
    return a.crossJoin(j).crossJoin(s)  # one row each


HEALTH_SQL = """
WITH a AS (SELECT n_name AS category, o_orderpriority AS language, o_orderdate AS ts FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'),
c AS (SELECT category, language, count(*) FILTER (WHERE ts >= TIMESTAMP '2001-08-02' - INTERVAL 720 HOUR) AS r, count(*) AS t FROM a GROUP BY ALL),
g AS (SELECT n_name AS category, language FROM nation, (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) v(language)),
h AS (SELECT category, language, coalesce(r, 0) AS count_recent, coalesce(t, 0) AS count_total, coalesce(r, 0) < 20 AS below_min FROM g LEFT JOIN c USING (category, language))
"""


@query("a2_content_health", HEALTH_SQL + "SELECT * FROM h")
def content_health(spark, sf, hours: int = 720, least: int = 20):
    since = F.lit(AS_OF) - F.make_dt_interval(hours=F.lit(hours))
    return dense_counts(categorised(spark, sf).where(F.col("status") == "F"), categories(spark, sf).select("category"), languages(spark), since, least)


@query("a15_low_inventory", HEALTH_SQL + "SELECT category, count(*) FILTER (WHERE below_min) AS n_low, count(*) AS n_pairs FROM h GROUP BY category")
def low_inventory(spark, sf):
    return content_health(spark, sf).groupBy("category").agg(F.count_if("below_min").alias("n_low"), F.count("*").alias("n_pairs"))


@query("k12_csv_projection", HEALTH_SQL + """SELECT '"' || replace(category, '"', '""') || '","' || replace(language, '"', '""') || '","' || count_recent || '","' || count_total || '","20","' || CASE WHEN below_min THEN 'below_target' ELSE 'healthy' END || '"' AS line FROM h""")
def csv_lines(spark, sf, least: int = 20):
    cells = content_health(spark, sf, least=least).select(F.array("category", "language", F.col("count_recent").cast("string"), F.col("count_total").cast("string"), F.lit(str(least)), F.when(F.col("below_min"), "below_target").otherwise("healthy")).alias("cells"))
    return cells.select(F.array_join(F.transform("cells", lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))), ",").alias("line"))


@query("a4_last_ingestion", "SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_fetched, count(*) AS n FROM events")
def last_ingestion(spark, sf):
    return table(spark, sf, "events").agg(moment(F.max("ts")).alias("last_fetched"), F.count("*").alias("n"))


@query("f5_stale_sources", """
SELECT s_suppkey AS source_id, strftime(max(l_shipdate), '%Y-%m-%d') AS last_fetched FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey AND l_returnflag = 'R' AND l_quantity > 45
WHERE s_acctbal > 0 GROUP BY s_suppkey HAVING max(l_shipdate) IS NULL OR max(l_shipdate) < TIMESTAMP '2001-07-01'""")
def stale_sources(spark, sf):
    last = jobs(spark, sf).where("status = 'R' AND quantity > 45").groupBy("source_id").agg(F.max("executed_at").alias("last"))
    s = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("source_id")).join(last, "source_id", "left")
    return s.where(F.col("last").isNull() | (F.col("last") < F.lit("2001-07-01").cast("timestamp"))).select("source_id", day("last").alias("last_fetched"))


@query("m3_readiness", """
WITH s AS (SELECT s_suppkey, max(l_shipdate) AS last FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey AND l_returnflag = 'R' AND l_quantity > 45 WHERE s_acctbal > 0 GROUP BY s_suppkey)
SELECT count(*) AS active_sources, count(*) FILTER (WHERE last IS NULL OR last < TIMESTAMP '2001-07-01') AS stale, CASE WHEN count(*) FILTER (WHERE last IS NULL OR last < TIMESTAMP '2001-07-01') = 0 THEN 'ok' ELSE 'degraded' END AS status FROM s""")
def readiness(spark, sf):
    stale = stale_sources(spark, sf).agg(F.count("*").alias("stale"))
    active = table(spark, sf, "supplier").agg(F.count_if(F.col("s_acctbal") > 0).alias("active_sources"))
    return active.crossJoin(stale).select("active_sources", "stale", F.when(F.col("stale") == 0, "ok").otherwise("degraded").alias("status"))  # one row each


@query("a5_article_total", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def article_total(spark, sf):
    return where_given(articles(spark, sf), status="F", language="1-URGENT", author_id=None).agg(F.count("*").alias("total"))


@query("a6_job_status_counts", "SELECT count(*) FILTER (WHERE l_returnflag = 'N') AS succeeded, count(*) FILTER (WHERE l_returnflag IN ('R', 'A')) AS not_succeeded, count(*) AS total FROM lineitem")
def job_status_counts(spark, sf):
    return jobs(spark, sf).agg(F.count_if(F.col("status") == "N").alias("succeeded"), F.count_if(F.col("status").isin("R", "A")).alias("not_succeeded"), F.count("*").alias("total"))


@query("a7_author_counts", "SELECT o_custkey AS author_id, count(*) FILTER (WHERE o_orderstatus = 'O') AS drafts, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending, count(*) FILTER (WHERE o_orderstatus = 'F') AS published FROM orders GROUP BY o_custkey")
def author_counts(spark, sf):
    return articles(spark, sf).groupBy("author_id").agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("O", "drafts"), ("P", "pending"), ("F", "published"))])


@query("a8_role_counts", "SELECT role, count(c_custkey) AS n FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('EDITOR'), ('MACHINERY')) v(role) LEFT JOIN customer ON c_mktsegment = role GROUP BY role")
def role_counts(spark, sf):
    roles = spark.createDataFrame([("AUTOMOBILE",), ("BUILDING",), ("EDITOR",), ("MACHINERY",)], "role string")
    return roles.join(users(spark, sf).groupBy("role").agg(F.count("*").alias("n")), "role", "left").select("role", F.coalesce("n", F.lit(0)).alias("n"))


@query("a9_group_by_date", "SELECT trim(strftime(o_orderdate, '%-d %B %Y')) AS label, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM orders WHERE o_orderstatus = 'P' GROUP BY label")
def grouped_by_date(spark, sf):
    from newsloom.functions.text import date_label

    rows = articles(spark, sf).where(F.col("status") == "P").select(date_label(F.col("published_at")).alias("label"), "id")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))


@query("a11_language_availability", "SELECT language, count(o_orderkey) > 0 AS available FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('9-NONE')) v(language) LEFT JOIN orders ON o_orderpriority = language AND o_orderstatus = 'F' GROUP BY language")
def language_availability(spark, sf):
    wanted = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("9-NONE",)], "language string")
    there = articles(spark, sf).where(F.col("status") == "F").select("language", F.lit(True).alias("there")).distinct()
    return wanted.join(there, "language", "left").select("language", F.coalesce("there", F.lit(False)).alias("available"))


@query("a12_success_ratio", "SELECT l_linestatus AS platform, count(*) FILTER (WHERE l_returnflag = 'N')::DOUBLE / count(*) AS ratio FROM lineitem GROUP BY l_linestatus")
def success_ratio(spark, sf):
    return jobs(spark, sf).groupBy("platform").agg((F.count_if(F.col("status") == "N") / F.count("*")).alias("ratio"))


@query("a13_any_every", "SELECT l_orderkey AS article_id, bool_or(l_returnflag = 'R') AS any_failed, bool_and(l_quantity > 10) AS every_large FROM lineitem GROUP BY l_orderkey")
def any_every(spark, sf):
    return jobs(spark, sf).groupBy("article_id").agg(F.bool_or(F.col("status") == "R").alias("any_failed"), F.bool_and(F.col("quantity") > 10).alias("every_large"))


@query("x4_rolling_inventory", """
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n
FROM (SELECT event_type, unnest([date_trunc('hour', ts) - to_hours(k) FOR k IN range(0, 24)]) AS w FROM events) GROUP BY ALL""")
def rolling(spark, sf):
    from newsloom.streaming.feeds import rolling_inventory

    return rolling_inventory(table(spark, sf, "events"), "event_type").select(moment("window_start").alias("window_start"), "event_type", "n")


@query("f4_recent_events", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR GROUP BY event_type")
def recent_events(spark, sf):
    e = table(spark, sf, "events").where(F.col("ts") >= F.lit(EVENTS_AS_OF) - F.make_dt_interval(hours=F.lit(24)))
    return e.groupBy("event_type").agg(F.count("*").alias("n"))


@query("u2_union_all", "SELECT 'customer' AS kind, count(*) AS n, count(DISTINCT k) AS n_keys FROM (SELECT c_nationkey AS k FROM customer) UNION ALL SELECT 'supplier', count(*), count(DISTINCT s_nationkey) FROM supplier UNION ALL SELECT 'nation', count(*), count(DISTINCT n_nationkey) FROM nation")
def union_all(spark, sf):
    parts = [table(spark, sf, t).select(F.lit(t).alias("kind"), F.col(k).alias("k")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("k").alias("n_keys"))
