"""
Feeds as they are on the web: RSS 2.0 and Atom documents, from files, tables or addresses, into items of FEED_ITEM's columns.

A document is one row (a feed is as long as one answer to a request); its items are parsed on the JVM by from_xml. A document that is no
well-formed XML, or neither of the two formats, gives one row with `error`, as a fetch that failed does, and stops no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import BROKEN, FEED_ITEM

#: Elements may have attributes, so that those of text are structs.
_TEXT = "struct<_VALUE:string>"
_MEDIA = "`media:content`: array<struct<_url:string,_type:string>>, `media:thumbnail`: array<struct<_url:string>>, `ht:image`: array<struct<_url:string>>"
_SCHEMA = f"""
channel struct<item: array<struct<title:string, link:string, pubDate:string, description:string, summary:string, enclosure: array<struct<_url:string,_type:string>>, {_MEDIA}>>>,
entry array<struct<title:{_TEXT}, link: array<struct<_href:string,_rel:string,_type:string>>, published:string, updated:string, content:{_TEXT}, summary:{_TEXT}, {_MEDIA}>>,
{BROKEN} string"""
SOURCE = ["source_id", "source_name", "source_language"]


def feed_documents(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """drop, document: whole files in UTF-8. A source is known by what the caller joins to `drop`."""
    rows = (spark.readStream if stream else spark.read).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("drop"), F.col("value").alias("document"))


def _fetch(url: str, seconds: float) -> str:
    import re
    import urllib.request
    import xml.parsers.expat

    with urllib.request.urlopen(url, timeout=seconds) as answer:
        found = answer.read()
    xml.parsers.expat.ParserCreate().Parse(found, True)  # what can't be parsed is asked for again, too
    named = re.match(rb"""\s*<\?xml[^>]*encoding=["']([A-Za-z0-9._-]+)["']""", found.removeprefix(b"\xef\xbb\xbf"))
    return found.decode(named[1].decode() if named else "utf-8-sig").removeprefix("﻿")


def fetched(sources: DataFrame, wait: float = 0.8, seconds: float = 8.0) -> DataFrame:
    """
    source_id, source_name, source_language, drop (its address), document, error: one row for each of `sources` (source_id, source_name,
    source_language, url), which tasks ask for. What fails or can't be parsed is asked for once more after `wait` seconds; the second
    error is kept. Sources are dealt out over all cores, as waiting is what takes the time.
    """

    def ask(batches):
        import socket
        import time
        import urllib.error

        import pyarrow as pa

        def one(url):
            error = None
            for turn in range(2):
                try:
                    return _fetch(url, seconds), None
                except urllib.error.HTTPError as e:
                    error = f"Status code {e.code}"
                except urllib.error.URLError as e:
                    error = f"{'getaddrinfo' if isinstance(e.reason, socket.gaierror) else 'URLError'}: {e.reason}"  # a name that nobody knows
                except Exception as e:  # whatever a server does, other sources go on
                    error = f"{type(e).__name__}: {e}"
                if turn == 0:
                    time.sleep(wait)
            return None, error

        for b in batches:
            told = [one(u.as_py()) if u.is_valid else (None, "no address") for u in b.column("drop")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([d for d, _ in told], pa.string()), pa.array([e for _, e in told], pa.string())], names=[*b.schema.names, "document", "error"])

    asked = sources.select(*SOURCE, F.col("url").alias("drop")).repartition(sources.sparkSession.sparkContext.defaultParallelism)
    kinds = ", ".join(f"{c} string" for c in [*SOURCE, "drop", "document", "error"])
    return asked.select(*[F.col(c).cast("string").alias(c) for c in [*SOURCE, "drop"]]).mapInArrow(ask, kinds)


def _some(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed != "", trimmed)


def _media(x: Column) -> list[Column]:
    of = lambda name, *fields: F.when(F.size(x[name]) > 0, F.struct(*[F.get(x[name], F.lit(0))[f"_{f}"].alias(f) for f in fields]))
    return [of("media:content", "url", "type").alias("media_content"), of("media:thumbnail", "url").alias("media_thumbnail"), of("ht:image", "url").alias("ht_image")]


def _plain(html: Column) -> Column:
    return _some(F.regexp_replace(html, "<[^>]*>", ""))


def _rss(x: Column) -> Column:
    enclosed = F.when(F.size(x["enclosure"]) > 0, F.struct(F.get(x["enclosure"], F.lit(0))["_url"].alias("url"), F.get(x["enclosure"], F.lit(0))["_type"].alias("type")))
    return F.struct(_some(x["title"]).alias("title"), _some(x["link"]).alias("link"), _some(x["pubDate"]).alias("pubDate"), x["description"].alias("content"), _plain(x["description"]).alias("contentSnippet"), x["summary"].alias("summary"), *_media(x), enclosed.alias("enclosure"))


def _atom(x: Column) -> Column:
    """An entry's address is that of its first link for readers, or else of its first."""
    own = F.get(F.filter(x["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    link, at = F.coalesce(own, F.get(x["link"], F.lit(0))["_href"]), F.coalesce(_some(x["published"]), _some(x["updated"]))
    body = x["content"]["_VALUE"]
    none = F.lit(None).cast("struct<url:string,type:string>")
    return F.struct(_some(x["title"]["_VALUE"]).alias("title"), _some(link).alias("link"), at.alias("pubDate"), body.alias("content"), _plain(body).alias("contentSnippet"), x["summary"]["_VALUE"].alias("summary"), *_media(x), none.alias("enclosure"))


def feed_rows(documents: DataFrame) -> DataFrame:
    """
    The lines of feed documents as feed_lines() has them for JSON: items in order (`item_pos` from 0), with `fault` and `_broken`.
    `documents` has drop, document, and maybe error and the columns of the source; nulls there are allowed. A feed without items has no line.
    """
    have = lambda c: F.col(c) if c in documents.columns else F.lit(None)
    docs = documents.select(*[have(c).cast("string").alias(c) for c in [*SOURCE, "error"]], "drop", "document")
    parsed = docs.withColumn("x", F.from_xml("document", _SCHEMA, {"columnNameOfCorruptRecord": BROKEN, "mode": "PERMISSIVE", "attributePrefix": "_", "valueTag": "_VALUE"}))
    root = F.regexp_extract("document", r"<(?![?!])\s*(?:[A-Za-z0-9_.-]+:)?([A-Za-z]+)", 1)
    error = F.coalesce(
        F.col("error"), F.when(F.col("document").isNull(), "no document"), F.when(F.col(f"x.{BROKEN}").isNotNull() | F.col("x").isNull(), "not well-formed XML"),
        F.when(~root.isin("rss", "RDF", "feed"), "neither RSS nor Atom"),
    )
    items = F.concat(F.transform(F.coalesce(F.col("x.channel.item"), F.array()), _rss), F.transform(F.coalesce(F.col("x.entry"), F.array()), _atom))
    kind = "array<struct<title:string,link:string,pubDate:string,content:string,contentSnippet:string,summary:string,media_content:struct<url:string,type:string>,media_thumbnail:struct<url:string>,ht_image:struct<url:string>,enclosure:struct<url:string,type:string>>>"
    rows = parsed.select(*SOURCE, "drop", error.alias("error"), F.when(error.isNull(), items).otherwise(F.array()).cast(kind).alias("items"), "document")
    rows = rows.where("error IS NOT NULL OR size(items) > 0").select(*SOURCE, "drop", "error", F.when(F.col("error").isNotNull(), F.col("document")).alias(BROKEN), F.posexplode_outer("items").alias("item_pos", "item"))
    fault = F.when(F.col("error").isNotNull(), F.concat(F.lit("fetch failed: "), F.col("error"))).when(F.col("item.title").isNull() & F.col("item.link").isNull(), "neither title nor link")
    return rows.select("item.*", *SOURCE, F.coalesce("item_pos", F.lit(0)).cast("long").alias("item_pos"), "error", BROKEN, "drop", fault.alias("fault"))


def fetch_drop(sources: DataFrame, drops: str, wait: float = 0.8, seconds: float = 8.0) -> None:
    """Asks all `sources` and adds their items, and what went wrong, to the feed drops that ingest() reads. Each feed's items lie in one file."""
    lines = feed_rows(fetched(sources, wait, seconds))
    lines.select(*StructType.fromDDL(FEED_ITEM).names).write.mode("append").json(drops)
