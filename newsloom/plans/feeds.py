"""Serving queries: pages, feeds, semi and anti joins, look-ups, nested children, search, similarity."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.operators.deep_pages import Pages, after
from newsloom.operators.relational import auto_approved, filled, first_by_key, page, searched, where_given
from newsloom.operators.similarity import accepted, near_duplicates
from newsloom.operators.storage import shared_dir
from newsloom.operators.text_index import TextIndex
from newsloom.sources.tables import table

from .crosswalk import AS_OF, articles, categories, categorised, day, jobs, users
from .registry import SQL, query


def newest(ts: str = "published_at", key: str = "id"):
    return [F.col(ts).desc_nulls_first(), F.col(key)]


@query("s3_ordered_scan", "SELECT n_nationkey AS category_id, n_name AS category, row_number() OVER (ORDER BY n_name, n_nationkey) AS place FROM nation")
def ordered_scan(spark, sf):
    from pyspark.sql.window import Window

    c = categories(spark, sf)  # a dimension of a few rows
    return c.select("category_id", "category", F.row_number().over(Window.orderBy("category", "category_id")).alias("place"))


@query("l1_article_page", "SELECT o_orderkey AS id, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS published FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 100 OFFSET 100")
def article_page(spark, sf):
    return page(where_given(articles(spark, sf), status="F", language=""), newest(), 2, 200).select("id", "status", day("published_at").alias("published"))


@query("l2_job_page", "SELECT l_orderkey AS article_id, l_linenumber AS number, l_returnflag AS status FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_shipdate DESC NULLS FIRST, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20 OFFSET 20")
def job_page(spark, sf):
    order = [F.col("executed_at").desc_nulls_first(), "article_id", "number", "tag_id", "source_id"]
    return page(where_given(jobs(spark, sf), status="R", platform=None), order, 2, 20, None).select("article_id", "number", "status")


_JOB_ORDER = [("executed_at", True), ("article_id", False), ("number", False), ("tag_id", False), ("source_id", False)]


@query("l2_deep_page", "SELECT l_orderkey AS article_id, l_linenumber AS number, l_returnflag AS status FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_shipdate DESC NULLS FIRST, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20 OFFSET 1180")
def deep_job_page(spark, sf):
    """The sixtieth page of jobs, from ranges of the order."""
    rows = where_given(jobs(spark, sf), status="R").select("article_id", "number", "tag_id", "source_id", "executed_at", "status")
    return Pages(rows, _JOB_ORDER).page(60, 20).select("article_id", "number", "status")


@query("l1_page_after", "SELECT o_orderkey AS id, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS published FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 100 OFFSET 100")
def page_after(spark, sf):
    """The page that follows the first hundred articles, by the key of the last of them."""
    rows, order = where_given(articles(spark, sf), status="F"), [("published_at", True), ("id", False)]
    last = rows.orderBy(*newest()).offset(99).limit(1).select("published_at", "id").first()
    return after(rows, order, last, 100).select("id", "status", day("published_at").alias("published"))


@query("l3_top_latest", "SELECT o_orderkey AS id, o_custkey AS author_id FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 5")
def top_latest(spark, sf):
    return articles(spark, sf).where(F.col("status") == "F").orderBy(*newest()).limit(5).select("id", "author_id")


@query("l4_latest_one", "SELECT o_custkey AS author_id, arg_max(o_orderkey, (o_orderdate, -o_orderkey)) AS latest_id FROM orders GROUP BY o_custkey")
def latest_one(spark, sf):
    return articles(spark, sf).groupBy("author_id").agg(F.max_by("id", F.struct("published_at", -F.col("id"))).alias("latest_id"))


_FEED = """
WITH b AS (SELECT o_orderkey AS id, o_orderdate AS ts, o_orderpriority AS language FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND n_name IN ('NATION_3', 'NATION_8')),
l AS (SELECT id, ts, 0 AS part FROM b WHERE language = '2-HIGH' ORDER BY ts DESC NULLS FIRST, id LIMIT 20),
g AS (SELECT id, ts, 1 AS part FROM (SELECT * FROM b WHERE language IN ('1-URGENT', '2-HIGH') ORDER BY ts DESC NULLS FIRST, id LIMIT 60) WHERE id NOT IN (SELECT id FROM l) ORDER BY ts DESC NULLS FIRST, id LIMIT 20)
"""


def _country_feed(spark, sf, local="2-HIGH", world="1-URGENT", limit=20, names=("NATION_3", "NATION_8")):
    wanted = categories(spark, sf).where(F.col("category").isin(*names)).select("category_id")
    own = users(spark, sf).join(F.broadcast(wanted), "category_id", "left_semi").select(F.col("id").alias("author_id"))  # at most as many as the names
    base = articles(spark, sf).where(F.col("status") == "F").join(own, "author_id", "left_semi").select("id", "published_at", "language")
    near = base.where(F.col("language") == local).orderBy(*newest()).limit(limit)
    far = base.where(F.col("language").isin(world, local)).orderBy(*newest()).limit(3 * limit)
    return near, far.join(near.select("id"), "id", "left_anti").orderBy(*newest()).limit(limit)


@query("l5_country_feed_mixed", _FEED + "SELECT id, part, row_number() OVER (ORDER BY coalesce(ts, TIMESTAMP '1970-01-01') DESC, part, id) AS place FROM (SELECT * FROM l UNION ALL SELECT * FROM g)")
def country_feed_mixed(spark, sf):
    from pyspark.sql.window import Window

    near, far = _country_feed(spark, sf)
    both = near.withColumn("part", F.lit(0)).unionByName(far.withColumn("part", F.lit(1)))
    order = Window.orderBy(F.coalesce("published_at", F.lit("1970-01-01").cast("timestamp")).desc(), "part", "id")  # two feeds of `limit` rows
    return both.select("id", "part", F.row_number().over(order).alias("place"))


@query("j16_global_minus_local", _FEED + "SELECT id FROM g")
def global_minus_local(spark, sf):
    return _country_feed(spark, sf)[1].select("id")


@query("j10_category_semi", "SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ('NATION_3', 'NATION_8'))")
def category_semi(spark, sf):
    own = users(spark, sf).join(categories(spark, sf).where(F.col("category").isin("NATION_3", "NATION_8")), "category_id", "left_semi")
    return articles(spark, sf).join(own.select(F.col("id").alias("author_id")), "author_id", "left_semi").select("id")


@query("l7_category_quota", "SELECT id, category, rank FROM (SELECT o_orderkey AS id, n_name AS category, row_number() OVER (PARTITION BY n_name ORDER BY o_orderdate, o_orderkey) AS rank FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) WHERE rank <= 20")
def category_quota(spark, sf):
    return first_by_key(categorised(spark, sf).select("id", "category", "published_at"), ["category"], ["published_at", "id"], 20, "rank").select("id", "category", "rank")


@query("s5_bounded_scan", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 100")
def bounded_scan(spark, sf):
    return first_by_key(table(spark, sf, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 100)


@query("l8_home_slices", "SELECT id, place, CASE WHEN place = 1 THEN 'hero' WHEN place <= 9 THEN 'breaking' ELSE 'rest' END AS slot FROM (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'F') WHERE place <= 29")
def home_slices(spark, sf):
    from pyspark.sql.window import Window

    top = articles(spark, sf).where(F.col("status") == "F").orderBy(*newest()).limit(29)
    top = top.withColumn("place", F.row_number().over(Window.orderBy(*newest())))  # 29 rows
    return top.select("id", "place", F.when(F.col("place") == 1, "hero").when(F.col("place") <= 9, "breaking").otherwise("rest").alias("slot"))


@query("l9_page_window", "SELECT ceil(count(*) / 20.0)::BIGINT AS pages, array_to_string(range(greatest(1, ceil(count(*) / 20.0)::BIGINT - 4), ceil(count(*) / 20.0)::BIGINT + 1), ',') AS buttons FROM orders")
def page_window(spark, sf):
    pages = F.ceil(F.count("*") / 20).alias("pages")
    return articles(spark, sf).agg(pages).select("pages", F.array_join(F.sequence(F.greatest(F.lit(1), F.col("pages") - 4), F.col("pages")).cast("array<string>"), ",").alias("buttons"))


@query("u3_section_fill", """
WITH f AS (SELECT o_orderkey AS id, o_orderdate AS ts, o_orderpriority AS language FROM orders WHERE o_orderstatus = 'P'),
p AS (SELECT id, ts, 0 AS part FROM f WHERE language = '1-URGENT' ORDER BY ts DESC NULLS FIRST, id LIMIT 5)
SELECT id, row_number() OVER (ORDER BY part, ts DESC NULLS FIRST, id) AS place FROM (SELECT * FROM p UNION ALL SELECT id, ts, 1 FROM f WHERE id NOT IN (SELECT id FROM p)) QUALIFY place <= 20""")
def section_fill(spark, sf):
    pool = articles(spark, sf).where(F.col("status") == "P").select("id", "published_at", "language")
    primary = pool.where(F.col("language") == "1-URGENT").orderBy(*newest()).limit(5)
    return filled(primary, pool, "id", newest(), 20).select("id", "place")


@query("f2_optional_filters", "SELECT count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey = 7")
def optional_filters(spark, sf):
    return where_given(articles(spark, sf), status=["F", "O"], author_id=7, language="").agg(F.count("*").alias("n"))


@query("f6_text_search", "SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red')")
def text_search(spark, sf):
    return searched(table(spark, sf, "part"), " Red ", ["p_name", "p_brand", "p_type"]).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("f6_index_search", SQL["f6_text_search"])
def index_search(spark, sf):
    """The same by an index of trigrams."""
    index = TextIndex(spark, f"{shared_dir(spark)}/newsloom-trigrams-{uuid.uuid4().hex}", "id", ["name", "brand", "type"])
    index.build(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type")))
    return index.search(" Red ").select("id", "name")


@query("f7_prefix", "SELECT p_partkey AS id FROM part WHERE starts_with(p_name, 'small')")
def prefix(spark, sf):
    return table(spark, sf, "part").where(F.startswith("p_name", F.lit("small"))).select(F.col("p_partkey").alias("id"))


@query("f8_language_match", "SELECT doc_id FROM documents WHERE lower(coalesce(lang, 'en')) = 'de'")
def language_match(spark, sf):
    return table(spark, sf, "documents").where(F.lower(F.coalesce("lang", F.lit("en"))) == "de").select("doc_id")


@query("f9_exclude_category", "SELECT s_suppkey AS id FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 3 WHERE n_regionkey IS DISTINCT FROM 2")
def exclude_category(spark, sf):
    c = categories(spark, sf).where("region_id < 3").select(F.col("category_id").alias("s_nationkey"), "region_id")
    return table(spark, sf, "supplier").join(c, "s_nationkey", "left").where(~F.col("region_id").eqNullSafe(2)).select(F.col("s_suppkey").alias("id"))


@query("f10_truthy", "SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND text <> ''")
def truthy(spark, sf):
    return table(spark, sf, "conversations").where(F.col("text").isNotNull() & (F.col("text") != "")).select("conv_id", "turn")


@query("f11_json_filter", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '69'")
def json_filter(spark, sf):
    return table(spark, sf, "events").where(F.get_json_object("props", "$.k") == "69").select("event_id")


@query("f13_playable", "SELECT page_id, url LIKE 'http%' OR lower(url) LIKE '%.mp4' AS playable FROM pages")
def playable(spark, sf):
    from newsloom.functions.text import is_playable

    return table(spark, sf, "pages").select("page_id", is_playable(F.col("url")).alias("playable"))


@query("f16_own_rows", "SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' OR o_custkey < 50")
def own_rows(spark, sf):
    u = users(spark, sf).select(F.col("id").alias("author_id"), "role")
    return articles(spark, sf).join(u, "author_id").where((F.col("role") != "BUILDING") | (F.col("author_id") < 50)).select("id")


@query("j1_article_tags", "SELECT o_orderkey AS id, count(p_partkey) AS n_tags, coalesce(string_agg(p_name || '#' || p_partkey, ',' ORDER BY p_name, p_partkey), '') AS tags FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey")
def article_tags(spark, sf):
    tag = table(spark, sf, "part").select(F.col("p_partkey").alias("tag_id"), F.col("p_name").alias("name"))
    own = jobs(spark, sf).select("article_id", "tag_id").distinct().join(tag, "tag_id").groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("name", "tag_id"))).alias("t"))
    names = F.array_join(F.transform("t", lambda x: F.concat(x["name"], F.lit("#"), x["tag_id"].cast("string"))), ",")
    return articles(spark, sf).select("id").join(own.withColumnRenamed("article_id", "id"), "id", "left").select("id", F.coalesce(F.size("t"), F.lit(0)).cast("long").alias("n_tags"), F.coalesce(names, F.lit("")).alias("tags"))


@query("j2_risk_left", "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def risk_left(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


@query("j3_first_media", "SELECT article_id, string_agg(number::VARCHAR, ',' ORDER BY r) AS numbers FROM (SELECT l_orderkey AS article_id, l_linenumber AS number, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r <= 3 GROUP BY article_id")
def first_media(spark, sf):
    top = first_by_key(jobs(spark, sf), ["article_id"], ["executed_at", "number", "tag_id", "source_id"], 3, "r")
    rows = top.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("r", "number"))).alias("m"))
    return rows.select("article_id", F.array_join(F.transform("m", lambda x: x["number"].cast("string")), ",").alias("numbers"))


@query("j4_latest_versions", "SELECT conv_id, turn, place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations) WHERE place <= 10")
def latest_versions(spark, sf):
    return first_by_key(table(spark, sf, "conversations").select("conv_id", "turn"), ["conv_id"], [F.desc("turn")], 10, "place")


@query("j6_first_of_type", "SELECT l_orderkey AS article_id, arg_min(l_partkey, (l_shipdate, l_linenumber, l_partkey)) FILTER (WHERE l_linestatus = 'O') AS first_video FROM lineitem GROUP BY l_orderkey")
def first_of_type(spark, sf):
    order = F.when(F.col("platform") == "O", F.struct("executed_at", "number", "tag_id"))
    return jobs(spark, sf).groupBy("article_id").agg(F.min_by("tag_id", order).alias("first_video"))


@query("j7_jobs_with_article", "SELECT l_orderkey AS article_id, l_linenumber AS number, o_orderstatus AS article_status, o_orderpriority AS language FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def jobs_with_article(spark, sf):
    a = articles(spark, sf).select(F.col("id").alias("article_id"), F.col("status").alias("article_status"), "language")
    return jobs(spark, sf).where(F.col("status") == "R").join(a, "article_id").select("article_id", "number", "article_status", "language")


@query("j8_has_video_semi", "SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F' AND l_returnflag = 'A')")
def has_video(spark, sf):
    v = jobs(spark, sf).where("platform = 'F' AND status = 'A'").select(F.col("article_id").alias("id"))
    return articles(spark, sf).select("id").join(v, "id", "left_semi")


@query("j9_digest_anti", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def digest_anti(spark, sf):
    posted = jobs(spark, sf).where(F.col("status") == "R").select(F.col("article_id").alias("id"))
    return articles(spark, sf).where(F.col("status") == "F").join(posted, "id", "left_anti").select("id")


@query("x5_digest_window", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '2001-08-02' - INTERVAL 2160 HOUR AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 5")
def digest_window(spark, sf, hours: int = 2160, most: int = 5):
    recent = articles(spark, sf).where((F.col("status") == "F") & (F.col("published_at") >= F.lit(AS_OF) - F.make_dt_interval(hours=F.lit(hours))))
    posted = jobs(spark, sf).where(F.col("status") == "R").select(F.col("article_id").alias("id"))
    return recent.join(posted, "id", "left_anti").orderBy(*newest()).limit(most).select("id")


@query("j13_auto_approve", """
SELECT doc_id FROM (SELECT doc_id, quality::DOUBLE AS confidence, toxic::DOUBLE AS score, source AS category FROM documents JOIN labels USING (doc_id)) r
WHERE EXISTS (SELECT 1 FROM (VALUES (NULL, 0.3, 0.8), ('src3', 1.0, 0.0)) v(c, s, m) WHERE (coalesce(c, '') = '' OR c = category) AND score <= s AND confidence >= m)""")
def auto_approve(spark, sf):
    risks = table(spark, sf, "documents").select("doc_id", F.col("source").alias("category")).join(table(spark, sf, "labels"), "doc_id").select("doc_id", "category", F.col("quality").cast("double").alias("confidence"), F.col("toxic").cast("double").alias("score"))
    rules = spark.createDataFrame([(None, 0.3, 0.8, True, True), ("src3", 1.0, 0.0, True, True), ("src4", 1.0, 0.0, False, True)], "category string, max_score double, min_confidence double, is_active boolean, auto_approve boolean")
    return auto_approved(risks, rules).select("doc_id")


TOKENS_SQL = """
WITH t AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: length(x) > 4))) AS t FROM documents),
c AS (SELECT t, min(doc_id) AS id, count(*) AS n, row_number() OVER (ORDER BY min(doc_id) NULLS LAST, sha256(array_to_string(t, ' '))) AS k FROM t WHERE len(t) > 0 GROUP BY t),
e AS (SELECT k, len(t) AS n, unnest(t) AS w FROM c),
l AS (SELECT a.k AS a, b.k AS b FROM e a JOIN e b ON a.w = b.w AND a.k <> b.k GROUP BY a.k, b.k, a.n, b.n HAVING count(*) * 100 >= (a.n + b.n - count(*)) * 70)
"""


@query("j14_near_duplicates", TOKENS_SQL + "SELECT doc_id, c.id AS class_id, coalesce(c.n - 1 + coalesce(o.n, 0), 0)::BIGINT AS n_links FROM t LEFT JOIN c USING (t) LEFT JOIN (SELECT l.a AS k, sum(c.n) AS n FROM l JOIN c ON c.k = l.b GROUP BY l.a) o ON o.k = c.k")
def near_duplicate_links(spark, sf):
    return near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


@query("x7_greedy_dedup", TOKENS_SQL.replace("WITH t AS", "WITH RECURSIVE t AS") + """
, nb AS MATERIALIZED (SELECT c.k, coalesce(x.b, []) AS near FROM c LEFT JOIN (SELECT b AS k, list(a) AS b FROM l WHERE a < b GROUP BY b) x USING (k)),
r(k, taken) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT nb.k, CASE WHEN list_has_any(taken, near) THEN taken ELSE list_append(taken, nb.k) END FROM r JOIN nb ON nb.k = r.k + 1),
f AS (SELECT unnest(taken) AS k FROM (SELECT taken FROM r ORDER BY k DESC LIMIT 1))
SELECT doc_id, c.k IS NULL OR (c.id IS NOT DISTINCT FROM doc_id AND c.k IN (SELECT k FROM f)) AS is_accepted FROM t LEFT JOIN c USING (t)""")
def greedy_dedup(spark, sf):
    """Sequential acceptance; tests hold it against a loop, too."""
    return accepted(table(spark, sf, "documents").select("doc_id", "text"))


@query("j15_exact_duplicates", "SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM benchmark) OR doc_id > (SELECT min(d.doc_id) FROM documents d WHERE d.text = documents.text)")
def exact_duplicates(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    first = d.groupBy("hash").agg(F.min("doc_id").alias("first"))
    known = table(spark, sf, "benchmark").select(F.sha2("text", 256).alias("hash"), F.lit(True).alias("known")).distinct()
    return d.join(first, "hash").join(known, "hash", "left").where((F.col("doc_id") > F.col("first")) | F.col("known")).select("doc_id")


@query("x2_dedup_keep_first", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def dedup_keep_first(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type", "props").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")).select("event_id")


@query("j17_key_exists", "SELECT k AS id, k IN (SELECT o_orderkey FROM orders) AS known FROM (VALUES (0), (1), (-5)) v(k)")
def key_exists(spark, sf):
    wanted = spark.createDataFrame([(0,), (1,), (-5,)], "id long")
    there = articles(spark, sf).where(F.col("id").isin(0, 1, -5)).select("id", F.lit(True).alias("there")).distinct()
    return wanted.join(there, "id", "left").select("id", F.coalesce("there", F.lit(False)).alias("known"))


@query("j18_lookup_chain", "SELECT p_partkey AS id, CASE WHEN p_partkey = 42 THEN 1 ELSE 2 END AS via FROM part WHERE p_partkey = 42 OR p_name = 'red widget' ORDER BY via, p_partkey LIMIT 1")
def lookup_chain(spark, sf, key: int = 42, name: str = "red widget"):
    rows = table(spark, sf, "part").where((F.col("p_partkey") == key) | (F.col("p_name") == name))
    return rows.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") == key, 1).otherwise(2).alias("via")).orderBy("via", "id").limit(1)


@query("j20_article_jobs", "SELECT l_orderkey AS article_id, l_linenumber AS number, l_returnflag AS status, l_linestatus AS platform FROM lineitem WHERE l_orderkey = 3")
def article_jobs(spark, sf):
    return jobs(spark, sf).where(F.col("article_id") == 3).select("article_id", "number", "status", "platform")


@query("j21_user_newest", "SELECT event_id FROM events WHERE user_id = 8 ORDER BY ts DESC, event_id LIMIT 50")
def user_newest(spark, sf):
    return table(spark, sf, "events").where(F.col("user_id") == 8).orderBy(F.col("ts").desc_nulls_first(), "event_id").limit(50).select("event_id")


@query("p2_relation_projection", "SELECT o_orderkey AS id, c_name AS author, c_mktsegment AS role FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def relation_projection(spark, sf):
    u = users(spark, sf).select(F.col("id").alias("author_id"), F.struct(F.col("name"), F.col("role")).alias("author"))
    return articles(spark, sf).select("id", "author_id").join(u, "author_id", "left").select("id", F.col("author.name").alias("author"), F.col("author.role").alias("role"))


@query("p5_coalesce_chain", "SELECT s_suppkey AS id, coalesce(nullif(CASE WHEN s_acctbal < 0 THEN '' WHEN s_acctbal < 1000 THEN NULL ELSE s_name END, ''), 'Untitled') AS title FROM supplier")
def coalesce_chain(spark, sf):
    name = F.when(F.col("s_acctbal") < 0, "").when(F.col("s_acctbal") >= 1000, F.col("s_name"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.coalesce(F.nullif(name, F.lit("")), F.lit("Untitled")).alias("title"))
