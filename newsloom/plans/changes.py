"""Writes and what goes with them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators.keyed import Keyed, Versions
from newsloom.operators.relational import updated
from newsloom.operators.storage import shared_dir
from newsloom.operators.tallies import Tallies, signed
from newsloom.operators.writes import audited, bridge_rows, free_slugs, write_csv
from newsloom.sources.tables import table

from . import lifecycle  # noqa: F401  its SQL is that of the writes, too
from .crosswalk import AS_OF, articles, categories, categorised, jobs
from .health import HEALTH_SQL, content_health, languages
from .registry import SQL, query

_state = lambda t: f"""CASE WHEN {t}.id IS NOT NULL THEN '{{"status":"' || {t}.status || '","author_id":' || {t}.author_id || '}}' END"""


@query("k11_audit_changes", f"""
WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey AS author_id FROM orders),
n AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'F' ELSE status END AS status, author_id FROM o WHERE id % 97 <> 0 UNION ALL SELECT -id, 'D', author_id FROM o WHERE id % 89 = 0 AND id > 0)
SELECT coalesce(n.author_id, o.author_id) AS actor, CASE WHEN o.id IS NULL THEN 'INSERT' WHEN n.id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS action, 'article' AS entity, coalesce(n.id, o.id) AS entity_id,
  {_state("o")} AS before, {_state("n")} AS after
FROM o FULL JOIN n ON o.id = n.id WHERE o.status IS DISTINCT FROM n.status""")
def audit_changes(spark, sf):
    """Articles set to F, deleted and added, told from the table before and after."""
    old = articles(spark, sf).select("id", "status", "author_id")
    drafts = old.where("id % 89 = 0 AND id > 0").select((-F.col("id")).alias("id"), F.lit("D").alias("status"), "author_id")
    new = updated(old.where("id % 97 <> 0"), F.col("id") % 10 == 0, status="F").unionByName(drafts)
    return audited(old, new, "id", ["status", "author_id"], "article", "author_id")


_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


@query("t1_slug_taken", f"""
WITH p AS (SELECT page_id, {_SLUG.format(_TITLE)} AS base FROM pages),
t AS (SELECT DISTINCT base FROM p WHERE page_id % 4 = 0)
SELECT page_id, p.base || CASE WHEN t.base IS NOT NULL THEN '-996710400000' ELSE '' END AS slug FROM p LEFT JOIN t ON t.base = p.base WHERE page_id % 4 <> 0""")
def slug_taken(spark, sf):
    """Slugs of new pages where every fourth page is there already; one that is taken is followed by the time in milliseconds."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    p = table(spark, sf, "pages").select("page_id", T.slug(title).alias("base"))
    now = (F.unix_timestamp(F.lit(AS_OF)) * 1000).cast("string")
    return free_slugs(p.where("page_id % 4 <> 0"), "base", p.where("page_id % 4 = 0"), "base", now).select("page_id", "slug")


@query("k2_bridge_rows", "SELECT DISTINCT l_orderkey AS article_id, l_partkey AS tag_id FROM lineitem WHERE l_partkey IS NOT NULL")
def article_bridge(spark, sf):
    """Articles come with a list of tag ids; the bridge has a row for each article and tag."""
    parents = jobs(spark, sf).groupBy("article_id").agg(F.collect_list("tag_id").alias("tag_ids"))
    return bridge_rows(parents, "article_id", "tag_ids", "tag_id")


@query("k12_csv_file", HEALTH_SQL + """SELECT '"category","language","count_recent","count_total","min_required","status"' AS line UNION ALL
SELECT '"' || replace(category, '"', '""') || '","' || replace(language, '"', '""') || '","' || count_recent || '","' || count_total || '","20","' || CASE WHEN below_min THEN 'below_target' ELSE 'healthy' END || '"' FROM h""")
def csv_file(spark, sf, least: int = 20):
    """The lines of the report's file, its header among them."""
    status = F.when(F.col("below_min"), "below_target").otherwise("healthy").alias("status")
    path = f"{shared_dir(spark)}/newsloom-report-{uuid.uuid4().hex}"
    write_csv(content_health(spark, sf, least=least).select("category", "language", "count_recent", "count_total", F.lit(least).alias("min_required"), status), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/newsloom-{name}-{uuid.uuid4().hex}"


def _table(spark, rows, name: str, schema: str) -> Keyed:
    t = Keyed(spark, _path(spark, name), schema, "id")
    t.create(rows)
    return t


@query("k3_point_write", SQL["k3_point_update"])
def point_write(spark, sf):
    """One article changed in its folder, and the table read back; so are the following."""
    t = _table(spark, articles(spark, sf), "articles", "id long, status string")
    t.update(F.col("id") == 5, keys=[5], status="X")
    return t.read()


@query("k4_bulk_write", SQL["k4_bulk_update"])
def bulk_write(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", F.lit(False).alias("is_read"))
    t = _table(spark, e, "events", "id long, user_id long, event_type string, is_read boolean")
    t.update((F.col("user_id") == 8) & (F.col("event_type") == "view"), is_read=True)
    return t.read().select(F.col("id").alias("event_id"), "is_read")


def _names(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = table(spark, sf, "supplier").select((F.col("s_suppkey") * 20 - 7).alias("id"), F.col("s_name").alias("name"))
    return _table(spark, old, "names", "id long, name string"), new


@query("k5_upsert_write", SQL["k5_upsert"])
def upsert_write(spark, sf):
    t, new = _names(spark, sf)
    t.upsert(new)
    return t.read()


@query("k5_insert_write", SQL["k5_insert_absent"])
def insert_write(spark, sf):
    t, new = _names(spark, sf)
    t.upsert(new, update=False)
    return t.read()


@query("k6_delete_write", SQL["k6_delete"])
def delete_write(spark, sf):
    t = _table(spark, table(spark, sf, "part").select(F.col("p_partkey").alias("id")), "parts", "id long")
    t.delete(jobs(spark, sf).where("status = 'R' AND quantity > 40").select(F.col("tag_id").alias("id")))
    return t.read()


@query("k7_soft_delete_write", SQL["k7_soft_delete"])
def soft_delete_write(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.lit(True).alias("is_active"))
    t = _table(spark, c, "users", "id long, balance double, is_active boolean")
    t.update(F.col("balance") < 0, is_active=False)
    return t.read().select("id", "is_active")


@query("k9_versions_write", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 2, turn) AS version FROM conversations")
def versions_write(spark, sf):
    """Two batches of versions: the even turns of all conversations, then the odd ones."""
    v = Versions(spark, _path(spark, "versions"), "conv_id long, turn long", "conv_id")
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    for batch in (0, 1):
        v.append(turns.where(F.col("turn") % 2 == batch), f"{batch}", ["turn"])
    return v.read()


_COUNTED = """
WITH a AS (SELECT o_orderkey AS id, n_name AS category, o_orderpriority AS language, o_orderdate AS ts, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
b AS (SELECT category, language, ts FROM a WHERE CASE WHEN id % 10 = 0 THEN 'F' WHEN id % 10 = 1 THEN 'O' ELSE status END = 'F' AND id % 97 <> 0),
c AS (SELECT category, language, count(*) FILTER (WHERE ts >= TIMESTAMP '2001-08-02' - INTERVAL 720 HOUR) AS r, count(*) AS t FROM b GROUP BY ALL)
SELECT n_name AS category, language, coalesce(r, 0) AS count_recent, coalesce(t, 0) AS count_total, coalesce(r, 0) < 20 AS below_min
FROM (SELECT DISTINCT n_name FROM nation), (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) v(language) LEFT JOIN c ON c.category = n_name AND c.language = v.language"""


@query("a2_tallied_health", _COUNTED.replace("SELECT n_name AS category, language,", "SELECT n_name AS category, v.language,"))
def tallied_health(spark, sf, hours: int = 720, least: int = 20):
    """The health report from counts kept up to date: articles are added, then some published or withdrawn, then some deleted."""
    tallies, groups = Tallies(spark, _path(spark, "tallies"), ["category", "language"]), ["category", "language"]
    seen = lambda rows: rows.where(F.col("status") == "F")
    a = categorised(spark, sf)
    tallies.add(signed(seen(a).limit(0), seen(a), groups, "published_at"), "1")
    moved = a.where("id % 10 IN (0, 1)")
    new = moved.withColumn("status", F.when(F.col("id") % 10 == 0, "F").otherwise("O"))
    tallies.add(signed(seen(moved), seen(new), groups, "published_at"), "2")
    gone = a.where("id % 97 = 0").withColumn("status", F.when(F.col("id") % 10 == 0, "F").when(F.col("id") % 10 == 1, "O").otherwise(F.col("status")))
    tallies.add(signed(seen(gone), seen(gone).limit(0), groups, "published_at"), "3")
    since = F.lit(AS_OF) - F.make_dt_interval(hours=F.lit(hours))
    counts = tallies.read().groupBy(*groups).agg(F.sum(F.when(F.col("hour") >= since, F.col("n")).otherwise(0)).alias("count_recent"), F.sum("n").alias("count_total"))
    grid = categories(spark, sf).select("category").crossJoin(languages(spark))  # code lists
    out = grid.join(counts, groups, "left").na.fill(0, ["count_recent", "count_total"])
    return out.select(*groups, "count_recent", "count_total", (F.col("count_recent") < least).alias("below_min"))
