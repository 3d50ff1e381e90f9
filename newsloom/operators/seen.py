"""
Keys that were taken before, asked without reading all of them.

Keys stand in folders by their hash (`part=...`), and in each in one for every batch that wrote there. A batch reads the folders that its
own keys fall into. Their number doubles whenever they would hold more than `per_part` keys on average, so what a batch reads is bounded by
its own keys, however long the history is; doubling rewrites the table, which costs each key a bounded number of rewrites over all time.
A folder with many batches becomes one of a single batch when it is next written to.

The table is a set: a key that stands in it twice, as after a merge that was cut short, changes no answer. Nothing is removed before what
takes its place is written. Names of batches ascend and begin with a digit; a batch that runs again doesn't see its own keys, and writes them
to the same folders. Null keys are never kept, and are never seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import deleted, discard, exists, folders, found, stored

_MERGED = "merged-"
_SCHEMA = "key string, part int, batch string"


def _before(batch: str) -> Column:
    return F.startswith("batch", F.lit(_MERGED)) | (F.col("batch") < batch)


class SeenKeys:
    def __init__(self, spark: SparkSession, path: str, per_part: int = 200_000, first_parts: int = 16, most_batches: int = 32):
        self.spark, self.path, self.per_part, self.first_parts, self.most_batches = spark, path, per_part, first_parts, most_batches

    def _parts(self) -> int | None:
        """How many folders there are: the largest number whose table was finished."""
        numbers = (int(n.removeprefix("parts=")) for n in folders(self.spark, self.path) if n.startswith("parts="))
        return max((n for n in numbers if exists(self.spark, f"{self.path}/parts={n}/_SUCCESS")), default=None)

    def _root(self, parts: int) -> str:
        return f"{self.path}/parts={parts}"

    @staticmethod
    def _part(parts: int) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")

    def _keys(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.select(F.col(key).cast("string").alias("key")).where("key IS NOT NULL")

    def _parts_of(self, keys: DataFrame, parts: int) -> list[int]:
        return sorted(r.part for r in keys.select(self._part(parts).alias("part")).distinct().collect())

    def _read(self, parts: int | None, which: list[int] | None = None) -> DataFrame:
        there = [n for n in folders(self.spark, self._root(parts)) if n.startswith("part=")] if parts else []
        wanted = there if which is None else sorted({f"part={k}" for k in which} & set(there))
        reader = self.spark.read.schema(_SCHEMA).option("basePath", self._root(parts))
        if wanted and len(wanted) == len(there):
            return reader.parquet(self._root(parts))  # one path to look into, not thousands
        return reader.parquet(*[f"{self._root(parts)}/{n}" for n in wanted]) if wanted else self.spark.createDataFrame([], _SCHEMA)

    def near(self, rows: DataFrame, key: str, before: str) -> DataFrame:
        """Column `key`: all keys of earlier batches in the folders that the keys of `rows` fall into, to be joined by the caller."""
        parts = self._parts()
        known = self._read(parts, self._parts_of(self._keys(rows, key), parts) if parts else [])
        return known.where(_before(before)).select(F.col("key").alias(key))

    def unseen(self, rows: DataFrame, key: str, before: str) -> DataFrame:
        """The rows whose key no earlier batch has added; those without a key, too. `rows` are read twice."""
        return rows.join(self.near(rows, key, before), key, "left_anti")

    def add(self, rows: DataFrame, key: str, batch: str, once: bool = False) -> None:
        """Keeps the keys of `rows`, in the name of `batch`. `once`: `rows` have each key once and are cheap to read again."""
        new = self._keys(rows, key) if once else stored(self._keys(rows, key).distinct(), "keys")
        had = self._parts()
        parts = had or self.first_parts
        sizes = {r.part: r.n for r in new.groupBy(self._part(parts).alias("part")).agg(F.count("*").alias("n")).collect()}
        before, batches = self._count(batch)
        total, mine = before + sum(sizes.values()), sorted(sizes)
        while total > parts * self.per_part:
            parts, mine = parts * 2, None
        if had and parts != had:
            # a key that stands there twice may do so on
            self._write(self._read(had).where(_before(batch)).select("key"), parts, f"{_MERGED}{batch}", "overwrite")
            for name in folders(self.spark, self.path):
                if name.startswith("parts=") and name != f"parts={parts}":
                    deleted(self.spark, f"{self.path}/{name}")
            batches = 1
        for at in found(self.spark, f"{self._root(parts)}/part=*/batch={batch}"):
            deleted(self.spark, at)
        if batches >= self.most_batches:  # no folder has more
            self._merge(parts, self._parts_of(new, parts) if mine is None else mine, batch)
        self._write(new, parts, batch, "append")
        self._note(batch, total, batches + 1)
        if not once:
            discard(new)

    def _write(self, keys: DataFrame, parts: int, batch: str, mode: str) -> None:
        rows = keys.withColumns({"part": self._part(parts), "batch": F.lit(batch)})
        rows.hint("rebalance", "part").write.mode(mode).partitionBy("part", "batch").parquet(self._root(parts))

    def _merge(self, parts: int, which: list[int], batch: str) -> None:
        """Of the folders to be written to, those with many batches become one."""
        root, into = self._root(parts), f"{_MERGED}{batch}"
        own = {k: [n for n in folders(self.spark, f"{root}/part={k}") if n not in (f"batch={into}", f"batch={batch}")] for k in which}
        full = [k for k, names in own.items() if len(names) >= self.most_batches]
        if not full:
            return
        self._write(self._read(parts, full).where(_before(batch)).select("key").distinct(), parts, into, "append")
        for k in full:
            for name in own[k]:
                deleted(self.spark, f"{root}/part={k}/{name}")

    def _count(self, before: str) -> tuple[int, int]:
        """The number of keys before a batch, and a number of batches that no folder exceeds."""
        names = [n.removeprefix("batch=") for n in folders(self.spark, f"{self.path}/counts") if n.startswith("batch=")]
        last = max((n for n in names if n < before and exists(self.spark, f"{self.path}/counts/batch={n}/_SUCCESS")), default=None)
        if last is None:
            return 0, 0
        note = self.spark.read.schema("n long, batches int").parquet(f"{self.path}/counts/batch={last}").first()
        return note.n, self.most_batches if note.batches is None else note.batches

    def _note(self, batch: str, n: int, batches: int) -> None:
        """The number of keys up to a batch; the one before stays, in case this batch runs again."""
        at = f"{self.path}/counts"
        older = sorted(x for x in folders(self.spark, at) if x.startswith("batch=") and x < f"batch={batch}")
        self.spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(batches).cast("int").alias("batches")).write.mode("overwrite").parquet(f"{at}/batch={batch}")
        for x in older[:-1]:
            deleted(self.spark, f"{at}/{x}")
