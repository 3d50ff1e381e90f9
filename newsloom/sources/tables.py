"""Readers: tables as Parquet, and feed drops as JSON with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as T

FEED_ITEM = """title string, link string, pubDate string, content string, contentSnippet string, summary string,
media_content struct<url:string,type:string>, media_thumbnail struct<url:string>, ht_image struct<url:string>,
enclosure struct<url:string,type:string>, source_id string, source_name string, source_language string, item_pos long, error string"""
#: Where the reader puts a line that it can't parse.
BROKEN = "_broken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feed_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """
    Lines of feed drops as JSON: items, or what a fetch failed with (`error`, and its source). With the file of each (`drop`) and what is
    wrong with it (`fault`; null: an item): lines that don't parse, fetch errors, items without title and link.
    """
    reader = spark.readStream if stream else spark.read
    rows = reader.schema(f"{FEED_ITEM}, {BROKEN} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).json(path)
    fault = F.when(F.col(BROKEN).isNotNull(), "not an item in JSON").when(F.col("error").isNotNull(), F.concat(F.lit("fetch failed: "), F.col("error"))).when(F.col("title").isNull() & F.col("link").isNull(), "neither title nor link")
    return rows.withColumns({"drop": F.col("_metadata.file_path"), "fault": fault})


def feed_items(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The items of feed drops; what is no item is left out (ingest() keeps it in a quarantine)."""
    return feed_lines(spark, path, stream).where("fault IS NULL").drop(BROKEN, "fault", "error")


def ingested(items: DataFrame) -> DataFrame:
    """The canonical columns of feed items."""
    body = F.coalesce("content", "contentSnippet", "summary", "title", F.lit(""))
    enclosed = F.when(F.startswith("enclosure.type", F.lit("image")), F.col("enclosure.url"))
    title = F.coalesce("title", F.lit("Untitled"))
    return items.select(
        "source_id", F.coalesce("link", F.lit("")).alias("source_url"), title.alias("source_title"), body.alias("body"), T.feed_time(F.col("pubDate")).alias("published_at"),
        T.content_hash(F.col("link"), F.col("title")).alias("content_hash"), T.category(title, F.coalesce("source_name", F.lit(""))).alias("category"),
        T.language_tag(T.feed_language(F.col("source_language"), F.coalesce("source_name", F.lit(""))), title, body).alias("language"),
        F.coalesce(F.col("media_content.url"), F.col("media_thumbnail.url"), enclosed, F.col("ht_image.url"), T.first_image(body)).alias("image_url"), "item_pos",
    )
