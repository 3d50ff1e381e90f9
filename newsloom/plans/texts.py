"""Text queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators.storage import spread
from newsloom.sources.tables import table

from . import sqltext as Q
from .crosswalk import AS_OF, articles
from .registry import query


def _sql_rules(rules: dict[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(t, '{words}') THEN '{name}'" for name, words in rules.items()) + f" ELSE '{otherwise}' END"


def _docs(spark, sf):
    return spread(table(spark, sf, "documents"))


_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def _title():
    return F.regexp_extract("html", "<title>([^<]*)</title>", 1)


@query("t1_slug", f"SELECT page_id, regexp_replace(regexp_replace(lower({_TITLE}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM pages")
def slug(spark, sf):
    """Slugs of the titles of pages."""
    return table(spark, sf, "pages").select("page_id", T.slug(_title()).alias("slug"))


@query("t1_slug_text", "SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents")
def slug_text(spark, sf):
    """The same of whole texts."""
    return _docs(spark, sf).select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("t2_raw_slug", "SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g')[1:60] AS slug FROM documents")
def raw_slug(spark, sf):
    return _docs(spark, sf).select("doc_id", T.raw_slug(F.col("text")).alias("slug"))


_HTML = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '</p>\s*<p[^>]*>', chr(10) || chr(10), 'gi'), '<br\s*/?>', chr(10), 'gi'), '<[^>]+>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"""


@query("t3_html_text", rf"SELECT page_id, sha256(regexp_replace({_HTML}, '^\s+|\s+$', '', 'g')[1:80000]) AS text_sha256 FROM pages")
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(T.html_text(F.col("html")), 256).alias("text_sha256"))


@query("t4_excerpt", r"SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g')[1:400] AS excerpt FROM pages")
def excerpt(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.excerpt(F.col("html")).alias("excerpt"))


@query("t5_paragraphs", r"SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''))::BIGINT AS n FROM documents")
def paragraphs(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(T.paragraphs(F.col("text"), "\n")).cast("long").alias("n"))


_KEY = r"regexp_replace(regexp_replace(regexp_replace(lower(p), '\s+', ' ', 'g'), '[^\p{L}\p{N}\s]', '', 'g'), '^\s+|\s+$', '', 'g')"


@query("t8_paragraph_dedup", rf"""
WITH p AS (SELECT doc_id, p, i, {_KEY} AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
f AS (SELECT doc_id, p, i FROM p WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY i) = 1),
o AS (SELECT doc_id, count(*) AS n, string_agg(regexp_replace(p, '^\s+|\s+$', '', 'g'), chr(10) ORDER BY i) AS t FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n, sha256(coalesce(t, '')) AS text_sha256 FROM documents d LEFT JOIN o USING (doc_id)""")
def paragraph_dedup(spark, sf):
    kept = T.distinct_paragraphs(T.paragraphs(F.col("text"), "\n"))
    return _docs(spark, sf).select("doc_id", kept.alias("k")).select("doc_id", F.size("k").cast("long").alias("n"), F.sha2(F.array_join("k", "\n"), 256).alias("text_sha256"))


@query("t9_paragraph_containment", f"SELECT doc_id, len({Q.uncontained('p')})::BIGINT AS n FROM (SELECT doc_id, {Q.parts('string_split(text, chr(10))')} AS p FROM documents)")
def paragraph_containment(spark, sf):
    """An ordered fold within a document; tests hold it against a loop, too."""
    kept = T.uncontained_paragraphs(T.paragraphs(F.col("text"), "\n"))
    return _docs(spark, sf).select("doc_id", F.size(kept).cast("long").alias("n"))


@query("t12_first_link", """SELECT page_id, nullif(regexp_extract(html, '(?i)<img[^>]+src=["'']([^"'']+)["'']', 1), '') AS image, nullif(regexp_extract(html, '(?i)<a[^>]+href=["'']([^"'']+)["'']', 1), '') AS link FROM pages""")
def first_link(spark, sf):
    link = F.nullif(F.regexp_extract("html", r"""(?i)<a[^>]+href=["']([^"']+)["']""", 1), F.lit(""))
    return table(spark, sf, "pages").select("page_id", T.first_image(F.col("html")).alias("image"), link.alias("link"))


@query("t14_parse_url", "SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '[?&]page=([^&]*)', 1), '') AS page FROM pages")
def parse_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.try_parse_url("url", F.lit("QUERY"), F.lit("page")).alias("page"))


@query("t15_category", "SELECT page_id, " + _sql_rules(T.CATEGORY_RULES, T.DEFAULT_CATEGORY) + f" AS category FROM (SELECT page_id, lower({_TITLE} || ' ' || regexp_extract(url, '^https?://([^/?#]+)', 1)) AS t FROM pages)")
def category(spark, sf):
    """Categories by the titles of pages and their hosts."""
    return table(spark, sf, "pages").select("page_id", T.category(_title(), F.try_parse_url("url", F.lit("HOST"))).alias("category"))


@query("t15_category_text", "SELECT doc_id, " + _sql_rules(T.CATEGORY_RULES, T.DEFAULT_CATEGORY) + " AS category FROM (SELECT doc_id, lower(text || ' ' || source) AS t FROM documents)")
def category_text(spark, sf):
    """The same of whole texts."""
    return _docs(spark, sf).select("doc_id", T.category(F.col("text"), F.col("source")).alias("category"))


@query("t16_source_language", "SELECT s_suppkey AS id, " + _sql_rules({k: "|".join(v) for k, v in T.SOURCE_LANGUAGES.items()}, "en") + " AS language FROM (SELECT s_suppkey, lower(CASE s_suppkey % 4 WHEN 0 THEN 'ABP Ananda ' WHEN 1 THEN 'Le Monde ' WHEN 2 THEN 'Geo Urdu Jang ' ELSE '' END || s_name) AS t FROM supplier)")
def source_language(spark, sf):
    prefix = F.when(F.col("s_suppkey") % 4 == 0, "ABP Ananda ").when(F.col("s_suppkey") % 4 == 1, "Le Monde ").when(F.col("s_suppkey") % 4 == 2, "Geo Urdu Jang ").otherwise("")
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), T.source_language(F.concat(prefix, F.col("s_name"))).alias("language"))


_SCRIPT = "CASE " + " ".join(f"WHEN regexp_matches(t, '[{chr(a)}-{chr(b)}]') THEN '{k}'" for k, (a, b) in T.SCRIPTS.items()) + " END"
_SCRIPT_TEXT = "SELECT doc_id, lang, text || CASE doc_id % 4 WHEN 0 THEN 'मैच' WHEN 1 THEN '漢字' WHEN 2 THEN 'Москва' ELSE '' END AS t FROM documents"


def _scripted(spark, sf):
    k = F.col("doc_id") % 4
    return _docs(spark, sf).select("doc_id", "lang", F.concat("text", F.when(k == 0, "मैच").when(k == 1, "漢字").when(k == 2, "Москва").otherwise("")).alias("t"))


@query("t17_script_language", f"SELECT doc_id, {_SCRIPT} AS script FROM ({_SCRIPT_TEXT})")
def script_language(spark, sf):
    return _scripted(spark, sf).select("doc_id", T.script_language(F.col("t")).alias("script"))


@query("t18_language_tag", f"SELECT doc_id, CASE WHEN lower(coalesce(nullif(lang, ''), 'en')) = 'en' THEN coalesce({_SCRIPT}, 'en') ELSE lower(lang) END AS tag FROM ({_SCRIPT_TEXT})")
def language_tag(spark, sf):
    return _scripted(spark, sf).select("doc_id", T.language_tag(F.col("lang"), F.col("t")).alias("tag"))


@query("t20_sha256", "SELECT page_id, sha256(coalesce(url, '')) AS content_hash FROM pages")
def sha256(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.content_hash(F.col("url"), F.lit(None).cast("string")).alias("content_hash"))


@query("t21_tokens", "SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: length(x) > 4)))::BIGINT AS n_tokens FROM documents")
def tokens(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("t22_html_escape", "SELECT page_id, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_sha256 FROM pages")
def html_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(T.escaped_html(F.col("html")), 256).alias("escaped_sha256"))


@query("t23_caption", "SELECT doc_id, (coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END, ''), source) || chr(10) || 'https://example.com/article/' || doc_id)[1:280] AS caption FROM documents")
def caption(spark, sf):
    own = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text"))
    return _docs(spark, sf).select("doc_id", T.short_caption(own, F.col("source"), T.public_url("https://example.com/", F.col("doc_id").cast("string"))).alias("caption"))


@query("t24_tagged_caption", "SELECT p_partkey AS id, p_name || chr(10) || 'https://example.com/article/' || p_partkey || chr(10) || '#' || p_brand || ' #' || p_type AS caption FROM part")
def tagged_caption(spark, sf):
    url = T.public_url("https://example.com", F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.tagged_caption(F.col("p_name"), url, F.array("p_brand", "p_type")).alias("caption"))


@query("t26_public_url", "SELECT o_orderkey AS id, 'https://example.com/article/' || o_orderkey AS url FROM orders")
def public_url(spark, sf):
    return articles(spark, sf).select("id", T.public_url("https://example.com//", F.col("id").cast("string")).alias("url"))


@query("t27_script_chunks", rf"""
SELECT doc_id, len(c)::BIGINT AS n_chunks, sha256(array_to_string(c, chr(10))) AS chunks_sha256 FROM (SELECT doc_id, CASE WHEN t = '' THEN ['Video update.'] ELSE {Q.packed('list_transform(' + Q.at_ends('t', '.!?') + ', lambda s: ' + Q.cut('s', 180) + ')', 180, 1)}[1:40] END AS c
FROM (SELECT doc_id, {Q.trim(r"regexp_replace(text, '\s+', ' ', 'g')")} AS t FROM documents))""")
def script_chunks(spark, sf):
    """An ordered fold within a text; tests hold it against a loop, too."""
    return _docs(spark, sf).select("doc_id", T.script_chunks(F.col("text"), 180).alias("c")).select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.sha2(F.array_join("c", "\n"), 256).alias("chunks_sha256"))


@query("t30_unfence", "SELECT event_id, props AS json FROM events")
def unfence(spark, sf):
    return table(spark, sf, "events").select("event_id", T.unfenced(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).alias("json"))


@query("s7_dead_source", "SELECT event_id, contains(lower(CASE WHEN event_type = 'error' THEN 'Status code ' || (400 + json_extract_string(props, '$.k')::INT) ELSE 'timeout' END), 'status code 404') OR regexp_matches(lower(CASE WHEN event_type = 'error' THEN 'Status code ' || (400 + json_extract_string(props, '$.k')::INT) ELSE 'timeout' END), 'status code (410|451|522|530)') AS dead FROM events")
def dead_source(spark, sf):
    message = F.when(F.col("event_type") == "error", F.concat(F.lit("Status code "), (F.get_json_object("props", "$.k").cast("int") + 400).cast("string"))).otherwise("timeout")
    return table(spark, sf, "events").select("event_id", T.is_dead_source(message).alias("dead"))


_COUNTRIES = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LOCALE_COUNTRIES.items()) + " END"


@query("t34_locale_country", f"SELECT doc_id, coalesce({_COUNTRIES}, {_COUNTRIES.replace('CASE t', 'CASE p')}, 'IN') AS country FROM (SELECT doc_id, t, string_split(t, '-')[1] AS p FROM (SELECT doc_id, lang || CASE doc_id % 3 WHEN 0 THEN '-US' WHEN 1 THEN '-XX' ELSE '' END AS t FROM documents))")
def locale_country(spark, sf):
    locale = F.concat("lang", F.when(F.col("doc_id") % 3 == 0, "-US").when(F.col("doc_id") % 3 == 1, "-XX").otherwise(""))
    return _docs(spark, sf).select("doc_id", T.locale_country(locale).alias("country"))


@query("d2_relative_age", "SELECT o_orderkey AS id, CASE WHEN m < 2 THEN 'Just now' WHEN m < 60 THEN m || 'm ago' WHEN m // 60 < 24 THEN (m // 60) || 'h ago' ELSE trim(strftime(o_orderdate, '%-d %b')) END AS age FROM (SELECT *, date_diff('minute', o_orderdate + to_minutes((o_orderkey % 1440)::INT), TIMESTAMP '2001-08-02') AS m FROM orders)")
def relative_age(spark, sf):
    ts = F.col("published_at") + F.make_dt_interval(mins=(F.col("id") % 1440).cast("int"))
    return articles(spark, sf).select("id", T.age_label(ts, F.lit(AS_OF)).alias("age"))


@query("d3_date_label", "SELECT o_orderkey AS id, trim(strftime(o_orderdate, '%-d %B %Y')) AS label FROM orders")
def date_label(spark, sf):
    return articles(spark, sf).select("id", T.date_label(F.col("published_at")).alias("label"))


@query("d5_srt_time", "SELECT event_id, printf('%02d:%02d:%02d,%03d', (s // 3600), (s // 60) % 60, s % 60, ms) AS srt FROM (SELECT event_id, (event_id * 37 // 8)::BIGINT AS s, ((event_id * 37 % 8) * 125)::BIGINT AS ms FROM events)")
def srt_time(spark, sf):
    return table(spark, sf, "events").select("event_id", T.srt_time(F.col("event_id") * 37 / 8).alias("srt"))


@query("r6_body_round_trip", r"SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''))::BIGINT AS n, sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10))) AS text_sha256 FROM documents")
def body_round_trip(spark, sf):
    """Paragraphs to a document node in JSON and back."""
    parts = T.body_paragraphs(T.body_json(T.paragraphs(F.col("text"), "\n")))
    return _docs(spark, sf).select("doc_id", parts.alias("p")).select("doc_id", F.size("p").cast("long").alias("n"), F.sha2(F.array_join("p", "\n"), 256).alias("text_sha256"))


@query("r9_flag_preview", "SELECT p_partkey AS id, array_to_string(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ')[1:3], ', ') AS flags FROM part")
def flag_preview(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.slice(F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " "), 1, 3), ", ").alias("flags"))
