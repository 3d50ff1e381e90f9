"""The news engine's tables, read from the tables at hand: orders are articles, line items their jobs and media, and so on."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.sources.tables import table

AS_OF = datetime(2001, 8, 2)
EVENTS_AS_OF = datetime(2024, 1, 31)


def articles(spark, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("language"), F.col("o_orderdate").alias("published_at"), F.col("o_totalprice").alias("price"))


def users(spark, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("category_id"), F.col("c_mktsegment").alias("role"), F.col("c_acctbal").alias("balance"))


def jobs(spark, sf: str) -> DataFrame:
    c = table(spark, sf, "lineitem")
    return c.select(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("tag_id"), F.col("l_suppkey").alias("source_id"), F.col("l_returnflag").alias("status"), F.col("l_linestatus").alias("platform"), F.col("l_shipdate").alias("executed_at"), F.col("l_quantity").alias("quantity"))


def categories(spark, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("category_id"), F.col("n_name").alias("category"), F.col("n_regionkey").alias("region_id"))


def categorised(spark, sf: str) -> DataFrame:
    """Articles with their author's category; authors and categories join by key."""
    a, u = articles(spark, sf), users(spark, sf).select(F.col("id").alias("author_id"), "category_id")
    return a.join(u, "author_id").join(categories(spark, sf), "category_id")


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


def moment(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
