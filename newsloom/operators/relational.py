"""Serving operators: optional filters, pages, first rows by key, unions by priority, dense grids, table versions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def where_given(df: DataFrame, **equal) -> DataFrame:
    """A conjunct for each parameter that is neither None nor empty; lists mean any of their values."""
    for name, value in equal.items():
        if value is not None and value != "":
            df = df.where(F.col(name).isin(value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df


def searched(df: DataFrame, term: str | None, columns: Sequence[str]) -> DataFrame:
    """Rows with the term in any of the columns, whatever its case; a blank term finds all."""
    term = (term or "").strip().lower()
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(term)), F.lit(False)) for c in columns])) if term else df


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20, most: int | None = 100) -> DataFrame:
    """Page `number` of the ordered rows; the size is clamped to 1 and `most`."""
    number, size = max(1, int(number or 1)), max(1, int(size or 20))
    size = min(size, most) if most else size
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of each key."""
    out = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def filled(primary: DataFrame, pool: DataFrame, key: str, order: Sequence[Column], least: int) -> DataFrame:
    """The primary rows, then those of the pool that are not among them, up to `least`, with their place."""
    both = primary.withColumn("_from", F.lit(0)).unionByName(pool.join(primary.select(key), key, "left_anti").withColumn("_from", F.lit(1)))
    top = both.orderBy("_from", *order).limit(least)
    return top.withColumn("place", F.row_number().over(Window.orderBy("_from", *order))).drop("_from")  # `least` rows


def dense_counts(rows: DataFrame, categories: DataFrame, languages: DataFrame, since: Column, least: int) -> DataFrame:
    """Each category and language with its rows since a time and in all; absent pairs count 0. Both dimensions are code lists."""
    counts = rows.groupBy("category", "language").agg(F.count_if(F.col("published_at") >= since).alias("count_recent"), F.count("*").alias("count_total"))
    grid = categories.crossJoin(languages)
    out = grid.join(counts, ["category", "language"], "left").na.fill(0, ["count_recent", "count_total"])
    return out.select("category", "language", "count_recent", "count_total", (F.col("count_recent") < least).alias("below_min"))


def upserted(table: DataFrame, rows: DataFrame, key: str, update: bool = True) -> DataFrame:
    """The table's next version: rows of known keys replace theirs (or are left out without `update`), others are added."""
    return rows.unionByName(table.join(rows.select(key), key, "left_anti")) if update else table.unionByName(rows.join(table.select(key), key, "left_anti"))


def without_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def updated(table: DataFrame, condition: Column, **values) -> DataFrame:
    """The table's next version with other values where the condition holds."""
    return table.withColumns({c: F.when(condition, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def auto_approved(risks: DataFrame, rules: DataFrame) -> DataFrame:
    """
    Risks that some active rule approves; a rule without category holds for all. Rules are an editor's short list: those of a category are
    one row, joined by it, and the general ones are a single row.
    """
    active, limits = rules.where("is_active AND auto_approve"), F.collect_list(F.struct("max_score", "min_confidence"))
    own = active.where(F.col("category") != "").groupBy(F.col("category").alias("_category")).agg(limits.alias("_own"))
    general = active.where(F.coalesce("category", F.lit("")) == "").agg(limits.alias("_general"))
    met = lambda rs: F.coalesce(F.exists(rs, lambda x: (F.col("score") <= x["max_score"]) & (F.col("confidence") >= x["min_confidence"])), F.lit(False))
    found = risks.join(own, risks["category"] == F.col("_category"), "left").crossJoin(general)
    return found.where(met("_own") | met("_general")).drop("_category", "_own", "_general")


def publishable(risks: DataFrame, rules: DataFrame, key: str, forced: Column, flag: bool) -> DataFrame:
    """`risks` with `approved`: forced, or by a rule, or because a flag approves all."""
    by_rule = auto_approved(risks, rules).select(key).distinct().withColumn("by_rule", F.lit(True))
    return risks.join(by_rule, key, "left").withColumn("approved", forced | F.coalesce("by_rule", F.lit(False)) | F.lit(flag)).drop("by_rule")


def after_attempt(jobs: DataFrame, failure: Column, success: Column, platform: Column | None = None, connectors: Sequence[str] = (), most: int = 3) -> DataFrame:
    """
    Jobs after one attempt: a failure counts a retry, and `most` of them end in the dead letters. With `platform`, jobs for
    the site itself succeed at once, and those for a platform without a connector go to the dead letters untried.
    """
    tries = F.col("retries") + 1
    tried = F.when(failure, F.when(tries >= most, "DEAD_LETTERED").otherwise("FAILED")).when(success, "SUCCESS").otherwise("FAILED")
    counted = F.when(failure, tries).otherwise(F.col("retries"))
    if platform is not None:
        site, none = platform == "WEB", ~platform.isin(list(connectors))
        tried = F.when(site, "SUCCESS").when(none, "DEAD_LETTERED").otherwise(tried)
        counted = F.when(site | none, F.col("retries")).otherwise(counted)
    return jobs.withColumns({"status": tried, "retries": counted})


def requeued(jobs: DataFrame, condition: Column) -> DataFrame:
    """A retry by hand: the jobs wait again, with no attempts counted."""
    return updated(jobs, condition, status="QUEUED", retries=0)


def prefix_taken(bases: DataFrame, slugs: DataFrame) -> DataFrame:
    """`bases` (column base) for which some of `slugs` (column slug) starts with it. Each slug is spread to its prefixes, so the join is on equal keys."""
    prefixes = slugs.where(F.length("slug") > 0).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("slug")), lambda n: F.substr("slug", F.lit(1), n))).alias("base")).distinct()
    return bases.join(prefixes, "base", "left_semi")
