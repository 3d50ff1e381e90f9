"""Publishing: payloads, platform texts, retries, provenance, users on demand; sources and their errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators.relational import after_attempt, first_by_key, prefix_taken, publishable, requeued, upserted
from newsloom.operators.storage import stored
from newsloom.sources.tables import FEED_ITEM, ingested, table
from newsloom.sources.web_feeds import feed_rows

from .crosswalk import AS_OF, articles, jobs, moment, users
from .registry import query

_PLATFORM = "CASE {n} % 5 WHEN 0 THEN 'WEB' WHEN 1 THEN 'TWITTER' WHEN 2 THEN 'TELEGRAM' WHEN 3 THEN 'YOUTUBE' ELSE 'FACEBOOK' END"


def _platform(n):
    return F.expr(_PLATFORM.format(n=n))


def _captions(spark, sf):
    """Captions by article and platform, the older first: what events say of the user's namesake article."""
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("article_id"), _platform("event_id").alias("platform"), F.col("ts").alias("created_at"), F.col("event_id").alias("caption_id"), F.col("props").alias("caption"))


_CAPTIONS = f"(SELECT user_id AS article_id, {_PLATFORM.format(n='event_id')} AS platform, arg_min(props, (ts, event_id)) AS caption FROM events GROUP BY ALL)"
_JOBS = f"(SELECT DISTINCT l_orderkey AS article_id, {_PLATFORM.format(n='l_linenumber')} AS platform FROM lineitem)"


def _job_captions(spark, sf):
    first = _captions(spark, sf).groupBy("article_id", "platform").agg(F.min_by("caption", F.struct("created_at", "caption_id")).alias("caption"))
    j = jobs(spark, sf).select("article_id", _platform("number").alias("platform")).distinct()
    return j.join(first, ["article_id", "platform"], "left")


@query("j5_job_captions", f"SELECT article_id, platform, caption FROM {_JOBS} LEFT JOIN {_CAPTIONS} USING (article_id, platform)")
def job_captions(spark, sf):
    """The first caption of a job's article for its platform."""
    return _job_captions(spark, sf)


@query("p6_payloads", f"""
WITH m AS (SELECT l_orderkey AS article_id, arg_min('https://example.com/v/' || l_partkey, (l_shipdate, l_linenumber, l_partkey)) FILTER (WHERE l_linestatus = 'O') AS video,
  arg_min('https://example.com/i/' || l_partkey, (l_shipdate, l_linenumber, l_partkey)) FILTER (WHERE l_linestatus = 'F') AS image FROM lineitem GROUP BY l_orderkey)
SELECT j.article_id, j.platform, 'Article ' || j.article_id AS title, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, 'Article ' || j.article_id) AS excerpt,
  'https://example.com/article/' || j.article_id AS url, image, video, caption FROM {_JOBS} j JOIN orders ON o_orderkey = j.article_id JOIN m ON m.article_id = j.article_id LEFT JOIN {_CAPTIONS} c ON c.article_id = j.article_id AND c.platform = j.platform""")
def payloads(spark, sf):
    """What goes to a platform: title, excerpt or title, address, first image and first video, caption."""
    order, link = F.struct("executed_at", "number", "tag_id"), lambda kind: F.concat(F.lit(f"https://example.com/{kind}/"), F.col("tag_id").cast("string"))
    media = jobs(spark, sf).groupBy("article_id").agg(F.min_by(link("v"), F.when(F.col("platform") == "O", order)).alias("video"), F.min_by(link("i"), F.when(F.col("platform") == "F", order)).alias("image"))
    key = F.col("id").cast("string")
    title = F.concat(F.lit("Article "), key)
    a = articles(spark, sf).select(F.col("id").alias("article_id"), title.alias("title"), F.coalesce(F.when(F.col("status") == "F", F.col("language")), title).alias("excerpt"), T.public_url("https://example.com", key).alias("url"))
    out = _job_captions(spark, sf).join(a, "article_id").join(media, "article_id")
    payload = F.struct("title", "excerpt", "url", "image", "video", "caption")
    return out.select("article_id", "platform", payload.alias("p")).select("article_id", "platform", "p.*")


@query("t25_platform_texts", """
SELECT p_partkey AS id, platform, CASE platform WHEN 'FACEBOOK' THEN said || chr(10) || chr(10) || url WHEN 'LINKEDIN' THEN said || chr(10) || url WHEN 'THREADS' THEN said || chr(10) || url
  WHEN 'WHATSAPP' THEN '*' || p_name || '*' || chr(10) || chr(10) || coalesce(nullif(p_type, ''), nullif(caption, ''), '') || chr(10) || chr(10) || url END AS said
FROM (SELECT *, coalesce(nullif(caption, ''), p_name) AS said, 'https://example.com/article/' || p_partkey AS url FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN p_brand END AS caption FROM part)), (VALUES ('FACEBOOK'), ('LINKEDIN'), ('THREADS'), ('WHATSAPP'), ('YOUTUBE')) v(platform)""")
def platform_texts(spark, sf):
    p = table(spark, sf, "part").withColumn("platform", F.explode(F.array(*map(F.lit, ("FACEBOOK", "LINKEDIN", "THREADS", "WHATSAPP", "YOUTUBE")))))
    caption = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.col("p_brand"))
    url = T.public_url("https://example.com", F.col("p_partkey").cast("string"))
    return p.select(F.col("p_partkey").alias("id"), "platform", T.platform_text(F.col("platform"), F.col("p_name"), F.col("p_type"), caption, url).alias("said"))


_SHOWN = "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(url_encode(url), '%3A', ':'), '%2F', '/'), '%3F', '?'), '%3D', '='), '%26', '&'), '%23', '#'), '%2C', ','), '%3B', ';'), '%40', '@'), '%2B', '+'), '%24', '$')"
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query("t22_link_texts", f"SELECT page_id, '<b>' || replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</b>' || chr(10) || chr(10) || 'a &lt; b' || chr(10) || chr(10) || '<a href=\"' || {_SHOWN} || '\">Read more</a>' AS said FROM (SELECT page_id, {_TITLE} AS t, url || ' é' AS url FROM pages)")
def link_texts(spark, sf):
    url = F.concat("url", F.lit(" é"))
    said = T.platform_text(F.lit("TELEGRAM"), _title(), F.lit("a < b"), F.lit(None).cast("string"), url)
    return table(spark, sf, "pages").select("page_id", said.alias("said"))


def _title():
    return F.regexp_extract("html", "<title>([^<]*)</title>", 1)


@query("t25_channel_target", "SELECT page_id, coalesce(CASE WHEN page_id % 4 = 0 THEN 'own' WHEN page_id % 4 = 1 THEN NULL END, nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+.*/([^/]+)/*$', 1), '')) AS target FROM pages")
def channel_target(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.channel_target(F.when(F.col("page_id") % 4 == 0, "own"), F.col("url")).alias("target"))


@query("t28_storage_key", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a/media/' || page_id ELSE url END AS key FROM pages")
def storage_key(spark, sf):
    own = F.concat(F.lit("https://s3.example.com/media/a/media/"), F.col("page_id").cast("string"))
    return table(spark, sf, "pages").select("page_id", T.storage_key(F.when(F.col("page_id") % 2 == 0, own).otherwise(F.col("url")), "media").alias("key"))


@query("t32_error_class", """
SELECT event_id, CASE WHEN event_type = 'signup' THEN 'known' WHEN event_id % 7 = 0 THEN 'quota' WHEN event_id % 7 IN (1, 2) THEN 'rate_limit' ELSE 'other' END AS class FROM events""")
def error_class(spark, sf):
    message = F.expr("CASE event_id % 7 WHEN 0 THEN '429 Quota exceeded for metric x' WHEN 1 THEN 'Too Many Requests' WHEN 2 THEN 'quota is used up' WHEN 3 THEN 'limit: 0' WHEN 4 THEN NULL ELSE 'timeout' END")
    return table(spark, sf, "events").select("event_id", T.error_class(message, F.when(F.col("event_type") == "signup", "P2002")).alias("class"))


@query("t2_slug_collision", """
WITH n AS (SELECT page_id, regexp_replace(lower(CASE WHEN page_id % 3 = 0 THEN 'small' ELSE """ + _TITLE + """ END), '[^a-z0-9]+', '-', 'g')[1:60] AS base FROM pages),
s AS (SELECT DISTINCT regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g')[1:60] AS slug FROM part)
SELECT page_id, base || CASE WHEN EXISTS (SELECT 1 FROM s WHERE starts_with(slug, base)) THEN '-996710400000' ELSE '' END AS slug FROM n""")
def slug_collision(spark, sf):
    """A slug that some article's slug starts with is followed by the time."""
    pages = table(spark, sf, "pages").select("page_id", T.raw_slug(F.when(F.col("page_id") % 3 == 0, "small").otherwise(_title())).alias("base"))
    slugs = table(spark, sf, "part").select(T.raw_slug(F.col("p_name")).alias("slug"))
    taken = prefix_taken(pages.select("base").distinct(), slugs).withColumn("taken", F.lit(True))
    suffix = F.when(F.col("taken"), F.concat(F.lit("-"), (F.unix_timestamp(F.lit(AS_OF)) * 1000).cast("string"))).otherwise("")
    return pages.join(taken, "base", "left").select("page_id", F.concat("base", suffix).alias("slug"))


_TRIED = _PLATFORM.format(n="l_partkey")


@query("m6_connectors", f"""
SELECT l_orderkey AS article_id, l_linenumber AS number, platform, CASE WHEN platform = 'WEB' THEN 'SUCCESS' WHEN platform = 'FACEBOOK' THEN 'DEAD_LETTERED' WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber % 4 + 1 >= 3 THEN 'DEAD_LETTERED' ELSE 'FAILED' END WHEN l_returnflag = 'N' THEN 'SUCCESS' ELSE 'FAILED' END AS status,
  (l_linenumber % 4 + CASE WHEN l_returnflag = 'R' AND platform NOT IN ('WEB', 'FACEBOOK') THEN 1 ELSE 0 END)::INT AS retries FROM (SELECT *, {_TRIED} AS platform FROM lineitem)""")
def connectors(spark, sf):
    """An attempt at each job where no connector for one platform is set."""
    j = jobs(spark, sf).select("article_id", "number", _platform("tag_id").alias("platform"), (F.col("number") % 4).cast("int").alias("retries"), F.col("status").alias("outcome"))
    out = after_attempt(j, F.col("outcome") == "R", F.col("outcome") == "N", F.col("platform"), ["TWITTER", "TELEGRAM", "YOUTUBE"])
    return out.select("article_id", "number", "platform", "status", "retries")


@query("m6_manual_retry", f"""
SELECT article_id, number, CASE WHEN status = 'DEAD_LETTERED' THEN 'QUEUED' ELSE status END AS status, CASE WHEN status = 'DEAD_LETTERED' THEN 0 ELSE retries END AS retries FROM (
SELECT l_orderkey AS article_id, l_linenumber AS number, CASE WHEN platform = 'WEB' THEN 'SUCCESS' WHEN platform = 'FACEBOOK' THEN 'DEAD_LETTERED' WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber % 4 + 1 >= 3 THEN 'DEAD_LETTERED' ELSE 'FAILED' END WHEN l_returnflag = 'N' THEN 'SUCCESS' ELSE 'FAILED' END AS status,
  (l_linenumber % 4 + CASE WHEN l_returnflag = 'R' AND platform NOT IN ('WEB', 'FACEBOOK') THEN 1 ELSE 0 END)::INT AS retries FROM (SELECT *, {_TRIED} AS platform FROM lineitem))""")
def manual_retry(spark, sf):
    """The dead letters, taken up again by hand."""
    return requeued(connectors(spark, sf), F.col("status") == "DEAD_LETTERED").select("article_id", "number", "status", "retries")


@query("m9_auto_publish", """
SELECT doc_id, doc_id % 10 = 0 OR EXISTS (SELECT 1 FROM (VALUES (NULL, 0.3, 0.8), ('src3', 1.0, 0.0)) v(c, s, m) WHERE (coalesce(c, '') = '' OR c = source) AND toxic::DOUBLE <= s AND quality::DOUBLE >= m) AS approved FROM documents JOIN labels USING (doc_id)""")
def auto_publish(spark, sf):
    """Forced, or by a rule; the flag that approves all is off."""
    risks = table(spark, sf, "documents").select("doc_id", F.col("source").alias("category")).join(table(spark, sf, "labels"), "doc_id").select("doc_id", "category", F.col("quality").cast("double").alias("confidence"), F.col("toxic").cast("double").alias("score"))
    rules = spark.createDataFrame([(None, 0.3, 0.8, True, True), ("src3", 1.0, 0.0, True, True)], "category string, max_score double, min_confidence double, is_active boolean, auto_approve boolean")
    return publishable(risks, rules, "doc_id", F.col("doc_id") % 10 == 0, False).select("doc_id", "approved")


@query("u7_requested_jobs", """
WITH p AS (SELECT l_orderkey AS id, bool_or(l_linestatus = 'O') AS video FROM lineitem GROUP BY l_orderkey)
SELECT id, unnest(CASE WHEN id % 2 = 0 THEN CASE WHEN video THEN ['YOUTUBE', 'TWITTER'] ELSE ['TWITTER'] END ELSE CASE WHEN video THEN ['WEB', 'TWITTER', 'YOUTUBE'] ELSE ['WEB', 'TWITTER'] END END) AS platform FROM p""")
def requested_jobs(spark, sf):
    """The requested platforms that are enabled, or all enabled ones; none for videos where there is no video."""
    a = jobs(spark, sf).groupBy(F.col("article_id").alias("id")).agg(F.bool_or(F.col("platform") == "O").alias("video"))
    names = lambda *x: F.array(*map(F.lit, x))
    enabled, requested = names("WEB", "TWITTER", "YOUTUBE"), F.when(F.col("id") % 2 == 0, names("YOUTUBE", "TWITTER", "THREADS"))
    active = F.coalesce(F.array_intersect(requested, enabled), enabled)
    return a.select("id", F.explode(F.when(F.col("video"), active).otherwise(F.array_except(active, names("YOUTUBE")))).alias("platform"))


@query("m8_editor", "SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 7 END, o_custkey) AS editor_id FROM orders")
def editor(spark, sf):
    """A transition names its editor where one is given."""
    given = F.when(F.col("id") % 3 == 0, F.lit(7))
    return articles(spark, sf).select("id", F.coalesce(given, F.col("author_id")).alias("editor_id"))


@query("k1_insert_rows", "SELECT status, count(*) AS n FROM (SELECT o_orderstatus AS status FROM orders UNION ALL SELECT 'D' FROM orders WHERE o_orderstatus = 'P') GROUP BY status")
def insert_rows(spark, sf):
    """New drafts join the table's rows."""
    a = articles(spark, sf)
    return a.unionByName(a.where("status = 'P'").withColumn("status", F.lit("D"))).groupBy("status").agg(F.count("*").alias("n"))


@query("k2_nested_insert", "SELECT DISTINCT conv_id AS article_id, unnest(string_split(role, 's')) AS tag FROM conversations")
def nested_insert(spark, sf):
    """Bridge rows of articles that come with a list of tags."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("article_id"), F.split("role", "s").alias("tags"))
    return c.select("article_id", F.explode("tags").alias("tag")).distinct()


@query("k10_provenance", "SELECT o_orderkey AS article_id, max(l_suppkey) AS source_id, 'Supplier#' || lpad(max(l_suppkey)::VARCHAR, 9, '0') AS source_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY o_orderkey")
def provenance(spark, sf):
    """Records appended for articles, then looked up by article; a record names the source."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source_name"))
    records = jobs(spark, sf).groupBy("article_id").agg(F.max("source_id").alias("source_id")).join(s, "source_id")
    a = articles(spark, sf).where("status = 'P'").select(F.col("id").alias("article_id"))
    return records.join(a, "article_id", "left_semi").select("article_id", "source_id", "source_name")


@query("k16_get_or_create", "SELECT c_custkey AS id, c_mktsegment AS role FROM customer WHERE c_mktsegment = 'MACHINERY' UNION ALL SELECT -1, 'AI_BOT'")
def get_or_create(spark, sf):
    """The table's next version has the one robot user, whether it was there or not."""
    u = users(spark, sf).select("id", "role").where(F.col("role").isin("AI_BOT", "MACHINERY"))
    return upserted(u, spark.createDataFrame([(-1, "AI_BOT")], "id long, role string"), "role", update=False)


@query("k16_any_admin", "SELECT min(c_custkey) AS id FROM customer WHERE c_mktsegment = 'BUILDING'")
def any_admin(spark, sf):
    return users(spark, sf).where("role = 'BUILDING'").orderBy("id").limit(1).select("id")


_UUID = "lower(md5(event_id::VARCHAR))"
_AS_UUID = f"CASE event_id % 4 WHEN 3 THEN 'x' ELSE '' END || {_UUID}[1:8] || '-' || {_UUID}[9:12] || '-' || {_UUID}[13:16] || '-' || {_UUID}[17:20] || '-' || {_UUID}[21:32]"


def _uuid():
    h = F.md5(F.col("event_id").cast("string"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.when(F.col("event_id") % 4 == 3, "x").otherwise(""), F.concat_ws("-", *parts))


@query("f12_uuid_route", f"SELECT event_id, CASE WHEN regexp_full_match({_AS_UUID}, '[0-9a-f-]{{36}}') THEN 'id' ELSE 'slug' END AS via FROM events")
def uuid_route(spark, sf):
    """Keys that look like ids are looked up as such, others as slugs."""
    return table(spark, sf, "events").select("event_id", F.when(T.is_uuid(_uuid()), "id").otherwise("slug").alias("via"))


@query("k17_quarantine", f"""
SELECT event_id, to_json(list_filter(['id', 'email', 'role', 'unknown'], lambda x: (x = 'id' AND event_id % 4 = 3) OR (x = 'email' AND event_id % 5 = 0) OR (x = 'role' AND event_type = 'error') OR (x = 'unknown' AND event_id % 6 = 0)))::VARCHAR AS faults
FROM events WHERE event_id % 4 = 3 OR event_id % 5 = 0 OR event_type = 'error' OR event_id % 6 = 0""")
def quarantine(spark, sf):
    """Requests as JSON, of a declared shape: those with a bad id, address, role or an unknown field, and why."""
    e = table(spark, sf, "events")
    email = F.when(F.col("event_id") % 5 == 0, "nobody.example.com").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com")))
    body = F.to_json(F.struct(_uuid().alias("id"), email.alias("email"), F.col("event_type").alias("role"), F.when(F.col("event_id") % 6 == 0, 1).alias("admin")))
    known = F.array(*map(F.lit, ("id", "email", "role")))
    r = e.select("event_id", F.from_json(body, "id string, email string, role string").alias("r"), F.json_object_keys(body).alias("keys"))
    faults = F.array(
        F.when(~T.is_uuid(F.col("r.id")), "id"), F.when(~F.col("r.email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email"),
        F.when(~F.col("r.role").isin("view", "click", "purchase", "signup"), "role"), F.when(F.size(F.array_except("keys", known)) > 0, "unknown"),
    )
    out = r.select("event_id", F.array_compact(faults).alias("faults")).where(F.size("faults") > 0)
    return out.select("event_id", F.to_json("faults").alias("faults"))


@query("f15_allowed", "SELECT s_suppkey AS id, s_name IN ('Supplier#000000001') OR s_nationkey IN (3, 8, 20) AS allowed FROM supplier")
def allowed(spark, sf):
    """Array membership: a list of allowed categories."""
    cats = F.array(*map(F.lit, (3, 8, 20)))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.array_contains(cats, F.col("s_nationkey")) | F.array_contains(F.array(F.lit("Supplier#000000001")), F.col("s_name"))).alias("allowed"))


@query("s4_feed_items", f"""
SELECT url AS source_url, sha256(url) AS content_hash, {_TITLE} AS source_title, strftime(TIMESTAMP '2024-01-02 03:04:05' + to_hours(page_id::INT), '%Y-%m-%d %H:%M:%S') AS published,
  CASE page_id % 4 WHEN 0 THEN 'm.png' WHEN 1 THEN 't.png' WHEN 2 THEN 'e.png' ELSE nullif(regexp_extract(html, '(?i)<img[^>]+src=["'']([^"'']+)["'']', 1), '') END AS image_url FROM pages""")
def feed_items(spark, sf):
    """Items as a feed's JSON, read with the declared schema into the canonical columns."""
    k = F.col("page_id") % 4
    at = F.date_format(F.lit("2024-01-02 03:04:05").cast("timestamp") + F.make_dt_interval(hours=F.col("page_id").cast("int")), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    image = lambda n, name: F.when(k == n, F.struct(F.lit(name).alias("url"), F.lit("image/png").alias("type")))
    line = F.to_json(F.struct(_title().alias("title"), F.col("url").alias("link"), at.alias("pubDate"), F.col("html").alias("content"), image(0, "m.png").alias("media_content"), image(1, "t.png").alias("media_thumbnail"), image(2, "e.png").alias("enclosure"), F.lit("s").alias("source_id"), F.lit("Daily").alias("source_name"), F.col("page_id").alias("item_pos")))
    items = table(spark, sf, "pages").select(F.from_json(line, FEED_ITEM).alias("i")).select("i.*")
    return ingested(items).select("source_url", "content_hash", "source_title", moment("published_at").alias("published"), "image_url")


@query("s4_web_feeds", f"""
SELECT feed, row_number() OVER (PARTITION BY feed ORDER BY page_id) - 1 AS item_pos, url AS source_url, sha256(url) AS content_hash, coalesce(nullif(trim({_TITLE}), ''), 'Untitled') AS source_title,
  strftime(TIMESTAMP '2024-01-02 03:04:05' + to_hours(page_id::INT), '%Y-%m-%d %H:%M:%S') AS published,
  CASE WHEN page_id % 4 = 0 THEN 'm.png' WHEN page_id % 4 = 1 THEN 't.png' WHEN page_id % 4 = 2 AND feed % 2 = 0 THEN 'e.png' ELSE nullif(regexp_extract(html, '(?i)<img[^>]+src=["'']([^"'']+)["'']', 1), '') END AS image_url
FROM (SELECT *, page_id // 25 AS feed FROM pages)""")
def web_feeds(spark, sf):
    """Pages as feeds of 25 items in XML, every second one Atom, stored as a crawl leaves them, and read into the canonical columns."""
    k, rss = F.col("page_id") % 4, F.floor(F.col("page_id") / 25) % 2 == 0
    at = F.lit("2024-01-02 03:04:05").cast("timestamp") + F.make_dt_interval(hours=F.col("page_id").cast("int"))
    title, url, html = (T.escaped_html(c) for c in (_title(), F.col("url"), F.col("html")))
    image = F.when(k == 0, '<media:content url="m.png" type="image/png"/>').when(k == 1, '<media:thumbnail url="t.png"/>').otherwise("")
    enclosure = F.when(k == 2, '<enclosure url="e.png" type="image/png"/>').otherwise("")
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), url, F.lit("</link><pubDate>"), F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.lit("</pubDate><description>"), html, F.lit("</description>"), image, enclosure, F.lit("</item>"))
    entry = F.concat(F.lit('<entry><title type="text">'), title, F.lit('</title><link href="'), url, F.lit('"/><updated>'), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('</updated><content type="html">'), html, F.lit("</content>"), image, F.lit("</entry>"))
    feeds = table(spark, sf, "pages").groupBy(F.floor(F.col("page_id") / 25).alias("drop")).agg(F.array_sort(F.collect_list(F.struct("page_id", F.when(rss, item).otherwise(entry).alias("x")))).alias("i"))
    inner = F.array_join(F.transform("i", lambda x: x["x"]), "")
    media = 'xmlns:media="http://search.yahoo.com/mrss/"'
    whole = F.when(F.col("drop") % 2 == 0, F.concat(F.lit(f'<rss version="2.0" {media}><channel><title>Daily</title>'), inner, F.lit("</channel></rss>"))).otherwise(F.concat(F.lit(f'<feed xmlns="http://www.w3.org/2005/Atom" {media}><title>Daily</title>'), inner, F.lit("</feed>")))
    crawl = stored(feeds.select("drop", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n'), whole).alias("document"), F.lit("s").alias("source_id"), F.lit("Daily").alias("source_name")), "crawl")
    lines = feed_rows(crawl).where("fault IS NULL")
    items = ingested(lines.withColumn("source_id", F.col("drop").cast("string")))
    return items.select(F.col("source_id").cast("long").alias("feed"), "item_pos", "source_url", "content_hash", "source_title", moment("published_at").alias("published"), "image_url")


@query("s6_source_isolation", "SELECT user_id AS source_id, count(*) FILTER (WHERE event_id % 9 <> 0) AS n_items, count(*) FILTER (WHERE event_id % 9 = 0) AS n_bad FROM events WHERE user_id % 3 <> 0 GROUP BY user_id")
def source_isolation(spark, sf):
    """Of active sources; a malformed payload is counted against its source and stops no other."""
    raw = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("{broken "), F.col("props"))).otherwise(F.col("props"))
    e = table(spark, sf, "events").where(F.col("user_id") % 3 != 0).select("user_id", F.from_json(raw, "k int, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("i"))
    bad = F.col("i._bad").isNotNull()
    return e.groupBy(F.col("user_id").alias("source_id")).agg(F.count_if(~bad).alias("n_items"), F.count_if(bad).alias("n_bad"))


@query("j20_article_facts", "SELECT o_orderkey AS id, o_orderstatus AS status, count(l_partkey) AS n_jobs, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (WHERE r <= 5) AS media FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) ON l_orderkey = o_orderkey WHERE o_orderkey < 200 GROUP BY ALL")
def article_facts(spark, sf):
    """Articles by key with their jobs and at most five media each."""
    keys = F.col("article_id") < 200
    j = jobs(spark, sf).where(keys)
    media = first_by_key(j, ["article_id"], ["number", "tag_id", "source_id"], 5, "r").groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("r", "tag_id"))).alias("m"))
    a = articles(spark, sf).where("id < 200").select(F.col("id").alias("article_id"), "status")
    out = a.join(j.groupBy("article_id").agg(F.count("*").alias("n")), "article_id", "left").join(media, "article_id", "left")
    return out.select(F.col("article_id").alias("id"), "status", F.coalesce("n", F.lit(0)).alias("n_jobs"), F.array_join(F.transform("m", lambda x: x["tag_id"].cast("string")), ",").alias("media"))


@query("j20_keyed_lookups", "SELECT 'user' AS kind, c_custkey::VARCHAR AS key, c_mktsegment AS value FROM customer WHERE c_name = 'Customer#000000042' UNION ALL SELECT 'risk', doc_id::VARCHAR, quality || '/' || toxic FROM labels WHERE doc_id = 1 UNION ALL SELECT 'source', s_suppkey::VARCHAR, s_name FROM supplier WHERE s_suppkey = 3")
def keyed_lookups(spark, sf):
    """A user by name, a risk by article, a source by id: each a filter on its key."""
    u = users(spark, sf).where("name = 'Customer#000000042'").select(F.lit("user").alias("kind"), F.col("id").cast("string").alias("key"), F.col("role").alias("value"))
    r = table(spark, sf, "labels").where("doc_id = 1").select(F.lit("risk").alias("kind"), F.col("doc_id").cast("string").alias("key"), F.concat_ws("/", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("value"))
    s = table(spark, sf, "supplier").where("s_suppkey = 3").select(F.lit("source").alias("kind"), F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("value"))
    return u.unionByName(r).unionByName(s)


@query("j18_slug_fallback", "SELECT k AS key, coalesce((SELECT min(p_partkey) FROM part WHERE p_partkey::VARCHAR = k), (SELECT min(p_partkey) FROM part WHERE p_brand || '/' || p_partkey = k), (SELECT max(p_partkey) FROM part WHERE p_name = k)) AS id FROM (VALUES ('42'), ('Brand#17/1'), ('red widget'), ('none')) v(k)")
def slug_fallback(spark, sf):
    """By id, else by slug, else by the search title, of which the newest is taken."""
    wanted = spark.createDataFrame([("42",), ("Brand#17/1",), ("red widget",), ("none",)], "key string")
    p, key = table(spark, sf, "part"), F.col("p_partkey").cast("string")
    steps = [(key, F.col("p_partkey")), (F.concat("p_brand", F.lit("/"), key), F.col("p_partkey")), (F.col("p_name"), -F.col("p_partkey"))]
    found = p.select(F.inline(F.array(*[F.struct(k.alias("key"), F.lit(i).alias("step"), order.cast("long").alias("place"), F.col("p_partkey").alias("id")) for i, (k, order) in enumerate(steps)])))
    best = found.join(F.broadcast(wanted), "key", "left_semi").groupBy("key").agg(F.min_by("id", F.struct("step", "place")).alias("id"))  # the keys of one request
    return wanted.join(best, "key", "left").select("key", "id")
