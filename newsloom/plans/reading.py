"""What readers see: article pages, images, videos, languages and countries; bodies as JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators.lookback import LookBack
from newsloom.operators.relational import first_by_key
from newsloom.operators.similarity import recent_duplicates
from newsloom.operators.storage import discard, shared_dir, spread
from newsloom.sources.tables import table

from . import sqltext as Q
from .countries import countries, sql_values
from .crosswalk import AS_OF, articles, jobs
from .feeds import TOKENS_SQL
from .health import HEALTH_SQL, content_health
from .registry import SQL, query


def _docs(spark, sf):
    return spread(table(spark, sf, "documents"))


def _digest(parts):
    return F.size(parts).cast("long").alias("n"), F.sha2(F.array_join(parts, "\n"), 256).alias("text_sha256")


_HTML = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '</p>\s*<p[^>]*>', chr(10) || chr(10), 'gi'), '<br\s*/?>', chr(10), 'gi'), '<[^>]+>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


@query("t5_blank_line_paragraphs", rf"""
SELECT page_id, len(p)::BIGINT AS n, sha256(array_to_string(p, chr(10))) AS text_sha256 FROM (
SELECT page_id, CASE WHEN len(p) = 0 THEN ['{T.EMPTY_BODY}'] ELSE p END AS p FROM (
SELECT page_id, list_filter(list_transform(regexp_split_to_array(t, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM (
SELECT page_id, CASE WHEN page_id % 10 = 0 THEN '' ELSE {_HTML} END AS t FROM pages)))""")
def blank_line_paragraphs(spark, sf):
    """Paragraphs of pages, or the placeholder."""
    text = F.when(F.col("page_id") % 10 == 0, "").otherwise(T.html_text(F.col("html"), 2**31 - 1))
    return table(spark, sf, "pages").select("page_id", T.or_placeholder(T.paragraphs(text)).alias("p")).select("page_id", *_digest("p"))


@query("t6_packed_sentences", f"""
SELECT doc_id, {Q.digest('p')} FROM (SELECT doc_id, CASE WHEN len(p) > 1 OR length(text) <= 600 THEN p ELSE {Q.parts(Q.packed('list_transform(s, lambda x: [x])', 450))} END AS p
FROM (SELECT doc_id, text, {Q.parts(Q.at_blank_lines('text'))} AS p, {Q.at_ends('text', '.!?।')} AS s FROM documents))""")
def packed_sentences(spark, sf):
    """An ordered fold within a text; tests hold it against a loop, too."""
    return _docs(spark, sf).select("doc_id", T.packed_sentences(F.col("text"), 600, 450).alias("p")).select("doc_id", *_digest("p"))


@query("t10_enriched_body", f"""
SELECT doc_id, length(b)::BIGINT AS n, sha256(b) AS text_sha256 FROM (SELECT doc_id, array_to_string({Q.uncontained('p')}, chr(10) || chr(10)) AS b FROM (
SELECT doc_id, {Q.parts('flatten(list_transform(g, lambda t: ' + Q.at_blank_lines(Q.trim('t')) + '))')} AS p FROM (SELECT doc_id, CASE WHEN length({Q.trim('text')}) >= 2400 THEN [text]
ELSE ['From ' || source || chr(10) || chr(10) || text, text, lang, source || chr(10) || chr(10) || 'and more'] END AS g FROM documents)))""")
def enriched_body(spark, sf):
    """Texts put together, with contained paragraphs left out; tests hold it against a loop, too."""
    body = T.enriched_body(F.col("text"), F.concat(F.lit("From "), "source", F.lit("\n\n"), "text"), F.col("lang"), F.concat("source", F.lit("\n\nand more")))
    return _docs(spark, sf).select("doc_id", F.length(body).cast("long").alias("n"), F.sha2(body, 256).alias("text_sha256"))


@query("t11_article_paragraphs", rf"""
SELECT doc_id, {Q.digest('p')} FROM (SELECT doc_id, {Q.distinct("CASE WHEN len(body) = 0 OR length(array_to_string(body, ' ')) < 900 THEN list_concat(body, rest) ELSE body END")} AS p FROM (
SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN {Q.parts('string_split(text, chr(10))')} ELSE [] END AS body,
  {Q.parts(r"string_split(regexp_replace(regexp_replace(f, '\n\s*\n', chr(1), 'g'), '([.!?।])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))")} AS rest
FROM (SELECT *, CASE WHEN doc_id % 2 = 0 AND {Q.trim('text')} <> '' THEN text || chr(10) || chr(10) ELSE '' END || source || ' said so. Then More.' AS f FROM documents)))""")
def article_paragraphs(spark, sf):
    """A page's paragraphs, with fallbacks where the body is short; tests hold it against a loop, too."""
    body = F.when(F.col("doc_id") % 3 != 0, T.body_paragraphs(T.body_json(T.paragraphs(F.col("text"), "\n"))))
    medium = F.when(F.col("doc_id") % 2 == 0, F.col("text"))
    parts = T.article_paragraphs(body, medium, F.lit(" "), F.concat("source", F.lit(" said so. Then More.")))
    return _docs(spark, sf).select("doc_id", parts.alias("p")).select("doc_id", *_digest("p"))


_LINK = "CASE page_id % 6 WHEN 0 THEN 'https://youtu.be/v' || page_id || '/x' WHEN 1 THEN 'https://www.youtube.com/watch?v=v' || page_id WHEN 2 THEN 'https://youtube.com/shorts/v' || page_id || '?a=b' WHEN 3 THEN 'https://youtubers.example.com/a' WHEN 4 THEN 'https://VIMEO.com/' || page_id ELSE url END"


@query("t13_video_url", rf"""
SELECT page_id, CASE WHEN page_id % 4 = 0 AND page_id % 8 = 0 THEN 'https://example.com/m.mp4' WHEN regexp_matches(link, '(?i)youtube\.com|youtu\.be|vimeo\.com') THEN link END AS video FROM (SELECT page_id, {_LINK} AS link FROM pages)""")
def video_url(spark, sf):
    """Of video types without an address, and of other types, links to video sites."""
    n = F.col("page_id")
    mime = F.when(n % 4 == 0, "video/mp4").when(n % 4 == 1, "text/html")
    media = F.when((n % 8 == 0) | (n % 4 == 1), "https://example.com/m.mp4")
    return table(spark, sf, "pages").select("page_id", T.video_url(mime, media, F.expr(_LINK)).alias("video"))


@query("t14_embed_url", f"SELECT page_id, CASE WHEN page_id % 6 < 3 THEN 'https://www.youtube.com/embed/v' || page_id END AS embed FROM (SELECT page_id, {_LINK} AS link FROM pages)")
def embed_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.embed_url(F.expr(_LINK)).alias("embed"))


_NAMES = "CASE s_suppkey % 4 WHEN 0 THEN 'ABP Ananda ' WHEN 1 THEN 'Le Monde ' WHEN 2 THEN 'Geo Urdu Jang ' ELSE '' END"


@query("t19_feed_language", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 2 THEN 'xx' ELSE CASE s_suppkey % 4 WHEN 0 THEN 'bn' WHEN 1 THEN 'fr' WHEN 2 THEN 'ur' ELSE 'en' END END AS language FROM supplier")
def feed_language(spark, sf):
    """An explicit language other than English, else what the source's name says."""
    given = F.expr("CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'en' ELSE 'xx' END")
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), T.feed_language(given, F.concat(F.expr(_NAMES), F.col("s_name"))).alias("language"))


@query("t29_slug_title", """
SELECT p_partkey AS id, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title, upper(p_type[1]) || p_type[2:] AS label FROM part""")
def slug_title(spark, sf):
    """A title from a slug, with its fallback number; a label with a capital."""
    slug = F.concat(T.slug(F.col("p_name")), F.lit("-fallback-"), F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.slug_title(slug).alias("title"), T.capitalised(F.col("p_type")).alias("label"))


_CODES = "[" + ", ".join(f"'{c}'" for c in T.APP_LANGUAGES) + "]"


@query("t34_locale_language", f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'ta' WHEN list_contains({_CODES}, lower(p)) THEN lower(p) ELSE 'en' END AS language FROM (SELECT doc_id, string_split(CASE doc_id % 4 WHEN 0 THEN upper(lang) || '-XX' WHEN 1 THEN 'sv-SE' WHEN 2 THEN 'pt' ELSE lang END, '-')[1] AS p FROM documents)")
def locale_language(spark, sf):
    locale = F.expr("CASE doc_id % 4 WHEN 0 THEN upper(lang) || '-XX' WHEN 1 THEN 'sv-SE' WHEN 2 THEN 'pt' ELSE lang END")
    stored = F.expr("CASE WHEN doc_id % 5 = 0 THEN 'ta' WHEN doc_id % 5 = 1 THEN 'tlh' END")
    return _docs(spark, sf).select("doc_id", T.locale_language(locale, stored).alias("language"))


@query("u6_country_languages", f"""
WITH s AS (SELECT source, min(lang) AS own, list(DISTINCT lang) AS extra FROM documents GROUP BY source)
SELECT source, array_to_string(list_sort(list_distinct(list_filter(list_concat(['en', own], extra), lambda x: list_contains({_CODES}, x)))), ',') AS languages FROM s""")
def country_languages(spark, sf):
    """The languages that a source's readers are offered: the default, its first and all further ones, as far as they are supported."""
    s = _docs(spark, sf).groupBy("source").agg(F.min("lang").alias("own"), F.collect_set("lang").alias("extra"))
    return s.select("source", F.array_join(F.array_sort(T.country_languages(F.col("own"), F.col("extra"))), ",").alias("languages"))


@query("j19_default_language", f"""
WITH a AS (SELECT lang, count(*) > 0 AS yes FROM documents GROUP BY lang)
SELECT code, CASE WHEN own.yes THEN preferred WHEN en.yes THEN 'en' ELSE preferred END AS language FROM (SELECT code, CASE WHEN list_contains({_CODES}, language) THEN language ELSE 'en' END AS preferred FROM {sql_values()}) LEFT JOIN a own ON own.lang = preferred LEFT JOIN a en ON en.lang = 'en'""")
def default_language(spark, sf):
    """A country's language where it has articles, else the default where that has."""
    there = _docs(spark, sf).select(F.col("lang").alias("preferred")).distinct().withColumn("yes", F.lit(True))
    c = countries(spark).select("code", F.when(F.col("language").isin(T.APP_LANGUAGES), F.col("language")).otherwise(T.DEFAULT_LANGUAGE).alias("preferred"))
    any_default = _docs(spark, sf).where(F.col("lang") == T.DEFAULT_LANGUAGE).limit(1).select(F.lit(True).alias("default_yes"))
    out = c.join(there, "preferred", "left").join(any_default, how="left")  # one row at most
    return out.select("code", T.default_language(F.col("preferred"), F.col("yes"), F.col("default_yes")).alias("language"))


@query("f14_same_region", "SELECT a.n_name AS nation, b.n_name AS neighbour, row_number() OVER (PARTITION BY a.n_nationkey ORDER BY b.n_nationkey) AS rank FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey QUALIFY rank <= 8")
def same_region(spark, sf, most: int = 8):
    """Other nations of a nation's region, the first eight: of a region only one more than that can be among them."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("nation"), F.col("n_regionkey").alias("region"))
    first = first_by_key(n.select("region", F.col("id").alias("other"), F.col("nation").alias("neighbour")), ["region"], ["other"], most + 1)
    pairs = n.join(first, "region").where(F.col("id") != F.col("other"))
    return first_by_key(pairs, ["id"], ["other"], most, "rank").select("nation", "neighbour", "rank")


@query("l6_languages_in_order", HEALTH_SQL + "SELECT category, string_agg(language, ',' ORDER BY language) AS languages FROM h WHERE below_min GROUP BY category")
def languages_in_order(spark, sf):
    """A category's languages that lack articles, in order."""
    rows = content_health(spark, sf).where("below_min").groupBy("category").agg(F.array_sort(F.collect_list("language")).alias("l"))
    return rows.select("category", F.array_join("l", ",").alias("languages"))


@query("p4_health_report", HEALTH_SQL + """
SELECT '2001-08-02 00:00:00' AS generated_at, 20 AS min_required, count(*) FILTER (WHERE below_min) AS n_low, count(*) AS n_rows, (SELECT count(*) FROM supplier) AS source_count, (SELECT strftime(max(l_shipdate), '%Y-%m-%d') FROM lineitem) AS last_ingestion FROM h""")
def health_report(spark, sf, least: int = 20):
    """The report's constant and derived columns."""
    h = content_health(spark, sf, least=least).agg(F.count_if("below_min").alias("n_low"), F.count("*").alias("n_rows"))
    s = table(spark, sf, "supplier").agg(F.count("*").alias("source_count"))
    j = jobs(spark, sf).agg(F.date_format(F.max("executed_at"), "yyyy-MM-dd").alias("last_ingestion"))
    head = [F.date_format(F.lit(AS_OF), "yyyy-MM-dd HH:mm:ss").alias("generated_at"), F.lit(least).alias("min_required")]
    return h.crossJoin(s).crossJoin(j).select(*head, "n_low", "n_rows", "source_count", "last_ingestion")  # one row each


@query("p7_json_merge", """
SELECT doc_id, 'doc' AS type, CASE WHEN doc_id % 2 = 0 THEN 'T' || doc_id END AS title, 'generated' AS status, 's' || source AS script, '2001-08-02T00:00:00Z' AS generated_at, 'https://example.com/v/' || doc_id AS video_url, CASE WHEN doc_id % 3 = 0 THEN 'i.png' END AS image FROM documents""")
def json_merge(spark, sf):
    """A video's fields join the body's JSON; what was there stays."""
    key = F.col("doc_id").cast("string")
    video = F.when(F.col("doc_id") % 2 == 0, F.struct(F.concat(F.lit("T"), key).alias("title"), F.lit("ready").alias("status")))
    body = F.to_json(F.struct(F.lit("doc").alias("type"), F.when(F.col("doc_id") % 3 == 0, "i.png").alias("imageUrl"), video.alias("aiVideo")))
    merged = T.with_video(body, F.concat(F.lit("s"), "source"), F.lit("2001-08-02T00:00:00Z"), F.concat(F.lit("https://example.com/v/"), key))
    at = lambda path: F.get_json_object("b", path)
    return _docs(spark, sf).select("doc_id", merged.alias("b")).select("doc_id", at("$.type").alias("type"), at("$.aiVideo.title").alias("title"), at("$.aiVideo.status").alias("status"), at("$.aiVideo.script").alias("script"), at("$.aiVideo.generatedAt").alias("generated_at"), at("$.aiVideo.videoUrl").alias("video_url"), at("$.imageUrl").alias("image"))


@query("r8_preferred_image", """
SELECT o_orderkey AS id, coalesce(i, CASE WHEN o_orderkey % 2 = 0 THEN 'body.png' END, 'https://picsum.photos/seed/a%20' || o_orderkey || '/800/450') AS image
FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_suppkey::VARCHAR || '.png', (l_linenumber, l_partkey, l_suppkey)) FILTER (WHERE l_linestatus = 'F' AND l_returnflag <> 'N') AS i FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def preferred_image(spark, sf):
    """The first image asset with an address, else the body's image, else a placeholder."""
    asset = F.struct("number", "tag_id", "source_id", F.when(F.col("platform") == "F", "IMAGE").otherwise("VIDEO").alias("type"), F.when(F.col("status") == "N", "").otherwise(F.concat(F.col("source_id").cast("string"), F.lit(".png"))).alias("url"))
    assets = jobs(spark, sf).groupBy(F.col("article_id").alias("id")).agg(F.array_sort(F.collect_list(asset)).alias("a"))
    body = F.when(F.col("id") % 2 == 0, "body.png")
    slug = F.concat(F.lit("a "), F.col("id").cast("string"))
    return articles(spark, sf).select("id").join(assets, "id", "left").select("id", T.preferred_image(F.coalesce("a", F.array().cast("array<struct<number:int,tag_id:long,source_id:long,type:string,url:string>>")), body, slug).alias("image"))


@query("r2_find_first", "SELECT l_orderkey AS article_id, arg_min(l_partkey, (l_linenumber, l_partkey)) FILTER (WHERE l_quantity > 25) AS found FROM lineitem GROUP BY l_orderkey")
def find_first(spark, sf):
    """The first element of a list for which a condition holds."""
    a = jobs(spark, sf).groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("number", "tag_id", "quantity"))).alias("a"))
    return a.select("article_id", F.try_element_at(F.filter("a", lambda x: x["quantity"] > 25), F.lit(1))["tag_id"].alias("found"))


@query("r3_some_every", "SELECT doc_id, len(list_filter(p, lambda x: length(x) > 200)) > 0 AS some_long, len(list_filter(p, lambda x: length(x) <= 20)) = 0 AS every_long FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)")
def some_every(spark, sf):
    """Whether some or every line of a text is long."""
    lines = F.split("text", "\n")
    return _docs(spark, sf).select("doc_id", F.exists(lines, lambda x: F.length(x) > 200).alias("some_long"), F.forall(lines, lambda x: F.length(x) > 20).alias("every_long"))


_AGES = "(SELECT *, date_diff('minute', o_orderdate + to_minutes((o_orderkey % 1440)::INT), TIMESTAMP '2001-08-02') AS m FROM orders)"


def _aged(spark, sf, **how):
    ts = F.col("published_at") + F.make_dt_interval(mins=(F.col("id") % 1440).cast("int"))
    return articles(spark, sf).select("id", T.age_label(ts, F.lit(AS_OF), **how).alias("age"))


@query("d2_archive_age", f"SELECT o_orderkey AS id, CASE WHEN m < 60 THEN m || 'm ago' WHEN m // 60 < 24 THEN (m // 60) || 'h ago' WHEN m // 1440 < 7 THEN (m // 1440) || 'd ago' ELSE trim(strftime(o_orderdate, '%-d %b')) END AS age FROM {_AGES}")
def archive_age(spark, sf):
    return _aged(spark, sf, just_now=-(2**31), days=7)


@query("d2_country_age", f"SELECT o_orderkey AS id, CASE WHEN m < 60 THEN m || 'm ago' WHEN m // 60 < 24 THEN (m // 60) || 'h ago' ELSE trim(strftime(o_orderdate, '%-d %b')) END AS age FROM {_AGES}")
def country_age(spark, sf):
    return _aged(spark, sf, just_now=-(2**31))


@query("d6_spaced_series", "SELECT o_orderkey AS id, row_number() OVER w - 1 AS place, strftime(TIMESTAMP '2001-08-02' - to_hours((3 * (row_number() OVER w - 1))::INT), '%Y-%m-%d %H:%M:%S') AS published FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def spaced_series(spark, sf, hours: int = 3):
    """An author's articles at descending times, three hours apart."""
    from pyspark.sql.window import Window

    place = (F.row_number().over(Window.partitionBy("author_id").orderBy("id")) - 1).cast("long")
    rows = articles(spark, sf).select("id", "author_id").withColumn("place", place)
    at = F.lit(AS_OF) - F.make_dt_interval(hours=(F.col("place") * hours).cast("int"))
    return rows.select("id", "place", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("x3_recent_duplicates", TOKENS_SQL + """
, p AS (SELECT doc_id, c.k AS class, TIMESTAMP '2024-01-01' + to_hours((doc_id % 4999)::INT) AS ts FROM t JOIN c USING (t)),
s AS (SELECT a, b FROM l UNION ALL SELECT k, k FROM c),
d AS (SELECT DISTINCT x.class, x.ts FROM p x JOIN s ON s.a = x.class JOIN p y ON y.class = s.b AND y.ts < x.ts AND y.ts >= x.ts - INTERVAL 7 DAY)
SELECT t.doc_id, d.class IS NOT NULL AS is_duplicate FROM t LEFT JOIN c USING (t) LEFT JOIN d ON d.class = c.k AND d.ts = TIMESTAMP '2024-01-01' + to_hours((t.doc_id % 4999)::INT)""")
def recently_seen(spark, sf, days: int = 7):
    """Texts alike to one that came in the seven days before; a document an hour."""
    ts = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("doc_id") % 4999).cast("int"))
    return recent_duplicates(table(spark, sf, "documents").select("doc_id", ts.alias("ts"), "text"), days)


@query("x3_lookback_index", SQL["x3_recent_duplicates"])
def seen_by_index(spark, sf, days: int = 7):
    """The same by the persisted index that ingestion uses: all texts are kept in it, then all are looked up."""
    ts = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("doc_id") % 4999).cast("int"))
    rows = table(spark, sf, "documents").select("doc_id", ts.alias("at"), "text")
    index = LookBack(spark, f"{shared_dir(spark)}/newsloom-index-{uuid.uuid4().hex}", days)
    rows = index.keyed(rows, "doc_id")
    index.add(rows, "000")
    found = index.repeated(rows, "doc_id").select("doc_id", F.col("is_repeat").alias("is_duplicate"))
    discard(rows)
    return found
