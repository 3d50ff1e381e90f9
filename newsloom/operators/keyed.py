"""
Tables that are changed where they lie. Rows stand in folders by a hash of their key (`part=...`), and a change reads and writes the
folders that its keys fall into; all others keep their files.

A change first stores the new rows of those folders, then puts them in place by Spark's dynamic partition overwrite. Each change sets a
state rather than adding to one, so running it again gives the same table; a driver that dies while folders are put in place has to run
its change again. One writer at a time.

Keys may be null: null is a key like others. Rows are cast to the table's schema; further columns are left out. Keys of a batch are distinct.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .relational import updated
from .storage import deleted, discard, folders, stored


def _overwrite(rows: DataFrame, path: str, *by: str) -> None:
    # a folder's rows in as few files as their size allows; large ones are split
    rows.hint("rebalance", by[0]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


class Keyed:
    """A table with one row for each key."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, parts: int = 64):
        self.spark, self.path, self.key, self.parts = spark, path, key, parts
        self.schema = StructType.fromDDL(schema)

    def _cast(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(c.name).cast(c.dataType).alias(c.name) for c in self.schema])

    def _keys(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.col(self.key).cast(self.schema[self.key].dataType).alias(self.key))

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def _parts_of(self, rows: DataFrame) -> list[int]:
        """The folders that hold the keys of `rows`: at most `parts` numbers."""
        return sorted(r.part for r in self._keys(rows).select(self._part().alias("part")).distinct().collect())

    def _read(self, parts: Sequence[int]) -> DataFrame:
        there = set(folders(self.spark, self.path))
        paths = [f"{self.path}/part={k}" for k in parts if f"part={k}" in there]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(range(self.parts))

    def get(self, *keys) -> DataFrame:
        """The rows of some keys, from their folders alone."""
        kind = StructType([self.schema[self.key]])
        wanted = self.spark.createDataFrame([(k,) for k in keys], kind)
        return self._read(self._parts_of(wanted)).where(F.col(self.key).isin([k for k in keys if k is not None]) | (F.col(self.key).isNull() if None in keys else F.lit(False)))

    def create(self, rows: DataFrame) -> None:
        """The table anew, whatever was there."""
        deleted(self.spark, self.path)
        _overwrite(self._cast(rows).withColumn("part", self._part()), self.path, "part")

    def _rewrite(self, parts: Sequence[int], change: Callable[[DataFrame], DataFrame]) -> None:
        if not parts:
            return
        new = stored(change(self._read(parts)).select(*self.schema.names).withColumn("part", self._part()), "changed")
        _overwrite(new, self.path, "part")
        left = {r.part for r in new.select("part").distinct().collect()}
        for k in set(parts) - left:  # nothing is left there, and an overwrite doesn't touch folders without new rows
            deleted(self.spark, f"{self.path}/part={k}")
        discard(new)

    def _absent(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        k = keys.select(F.col(self.key).alias("_key"))
        return rows.join(k, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti")

    def upsert(self, rows: DataFrame, update: bool = True) -> None:
        """Rows of known keys take the place of theirs (without `update` they are left out); others are added."""
        rows = stored(self._cast(rows), "rows")
        new = (lambda old: rows.unionByName(self._absent(old, rows))) if update else (lambda old: old.unionByName(self._absent(rows, old)))
        self._rewrite(self._parts_of(rows), new)
        discard(rows)

    def delete(self, keys: DataFrame) -> None:
        """Rows of these keys go."""
        keys = stored(self._keys(keys).distinct(), "keys")
        self._rewrite(self._parts_of(keys), lambda old: self._absent(old, keys))
        discard(keys)

    def update(self, condition: Column, keys: Sequence | None = None, **values) -> None:
        """
        Other values where the condition holds. Of the table only the condition's columns are read to find the folders with such rows;
        with `keys`, only their folders.
        """
        if self.key in values:
            raise ValueError("a key doesn't change: delete the row and add another")
        known = self.read() if keys is None else self.get(*keys)
        held = condition if keys is None else condition & (F.col(self.key).isin([k for k in keys if k is not None]) | (F.col(self.key).isNull() if None in keys else F.lit(False)))
        self._rewrite(self._parts_of(known.where(condition)), lambda old: self._cast(updated(old, held, **values)))


class Versions:
    """
    Every state of rows, numbered from 1 by key in order of batches; nothing is ever changed. Folders by key and batch: a batch reads
    the key and number of the folders that it adds to, and one that runs again takes the place of what it wrote. Names of batches ascend.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, parts: int = 64):
        self.spark, self.path, self.rows = spark, path, Keyed(spark, path, schema, key, parts)
        self.schema = f"{schema}, version long, part int, batch string"

    def _read(self, parts: Sequence[int] | None = None) -> DataFrame:
        names = folders(self.spark, self.path)
        names = [n for n in names if n.startswith("part=") and (parts is None or int(n.removeprefix("part=")) in parts)]
        reader = self.spark.read.schema(self.schema).option("basePath", self.path)
        return reader.parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame, batch: str, order: Sequence[str] = ()) -> None:
        """A new version for each row; several of one key are numbered in the order of some columns, which are unique within it."""
        t = self.rows
        rows = stored(t._cast(rows), "rows")
        for n in folders(self.spark, self.path):
            if n.startswith("part="):
                deleted(self.spark, f"{self.path}/{n}/batch={batch}")
        known = self._read(set(t._parts_of(rows))).where(F.col("batch") < batch).groupBy(F.col(t.key).alias("_key")).agg(F.max("version").alias("last"))
        place = F.row_number().over(Window.partitionBy(t.key).orderBy(*(order or [t.key])))
        new = rows.withColumn("place", place).join(known, F.col(t.key).eqNullSafe(F.col("_key")), "left")
        new = new.withColumn("version", F.coalesce("last", F.lit(0)) + F.col("place")).withColumns({"part": t._part(), "batch": F.lit(batch)})
        _overwrite(new.select(*t.schema.names, "version", "part", "batch"), self.path, "part", "batch")
        discard(rows)

    def read(self) -> DataFrame:
        return self._read().drop("part", "batch")

    def latest(self, *keys, k: int = 1) -> DataFrame:
        """The last k versions of some keys (none given: of all)."""
        rows = self._read()
        if keys:
            kind = StructType([self.rows.schema[self.rows.key]])
            rows = self._read(set(self.rows._parts_of(self.spark.createDataFrame([(x,) for x in keys], kind)))).where(F.col(self.rows.key).isin(list(keys)))
        rank = F.row_number().over(Window.partitionBy(self.rows.key).orderBy(F.desc("version")))
        return rows.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank", "part", "batch")
