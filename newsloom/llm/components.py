"""Connected components of a distributed list of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """
    Each node's neighbours are linked to the least of node and neighbours: the greater neighbours (large star), or the
    smaller ones and the node itself (small star). Minima are pre-aggregated; the join back can be split where skewed.
    """
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each node of `links` (u, v), the least id reachable."""
    links = stored(links.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "links")
    seen = None
    while True:
        before, links = links, stored(_stars(_stars(links, True), False), "stars")
        discard(before)
        # two numbers tell whether anything changed
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return links.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = now
