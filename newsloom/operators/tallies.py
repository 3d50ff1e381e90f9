"""
Counts kept up to date: each change of a row is minus one where it was and plus one where it is, and a batch's sums are added to the
counts that it touches. Nothing is counted again.

Counts stand by group and hour, so that a report over the last hours adds up few rows. Each count keeps the last batch that it knows: a
batch that runs again adds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .keyed import Keyed
from .storage import discard, stored


def signed(before: DataFrame, after: DataFrame, groups: Sequence[str], time: str) -> DataFrame:
    """*groups, hour, n: what the states before and after a batch of changes add to each count; rows without a time have a null hour."""
    side = lambda df, by: df.select(*groups, F.date_trunc("HOUR", time).alias("hour"), F.lit(by).alias("by"))
    both = side(before, -1).unionByName(side(after, 1))
    return both.groupBy(*groups, "hour").agg(F.sum("by").alias("n")).where("n <> 0")


class Tallies:
    """Numbers of rows by groups (strings) and hour."""

    def __init__(self, spark: SparkSession, path: str, groups: Sequence[str], parts: int = 16):
        self.groups = list(groups)
        fields = ", ".join(f"{g} string" for g in groups)
        self.table = Keyed(spark, path, f"key string, {fields}, hour timestamp, n long, batch string", "key", parts)

    def _keyed(self, sums: DataFrame) -> DataFrame:
        of = [F.col(g).cast("string").alias(g) for g in self.groups]
        rows = sums.select(*of, "hour", F.col("n").alias("by"))
        return rows.withColumn("key", F.sha2(F.to_json(F.struct(*self.groups, "hour"), {"ignoreNullFields": "false"}), 256))

    def add(self, sums: DataFrame, batch: str) -> None:
        """Adds a batch's signed sums (*groups, hour, n); names of batches ascend."""
        new = stored(self._keyed(sums), "sums")
        old = self.table._read(self.table._parts_of(new)).select("key", F.col("n").alias("known"), F.col("batch").alias("last"))
        done = F.coalesce(F.col("last") >= batch, F.lit(False))
        rows = new.join(old, "key", "left").where(~done).withColumn("n", F.coalesce("known", F.lit(0)) + F.col("by")).withColumn("batch", F.lit(batch))
        self.table.upsert(rows)
        discard(new)

    def read(self) -> DataFrame:
        """*groups, hour, n; counts of zero are kept, as their batch must be known, and left out here."""
        return self.table.read().where("n <> 0").select(*self.groups, "hour", "n")
