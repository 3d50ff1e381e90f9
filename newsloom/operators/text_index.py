"""
Substring search by an index of trigrams: each row's distinct runs of three characters, in lower case, as postings in folders by a hash
of the trigram, sorted. A search reads the folders of the term's trigrams, keeps the keys that have all of them, and looks at the texts of
those rows only. Terms of one or two characters have no trigram: all rows are looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .keyed import Keyed
from .relational import searched
from .storage import deleted, exists

_POSTINGS = "gram string, key long"


def _grams(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substr(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


class TextIndex:
    """Rows with a key (long, distinct, not null) and text columns; null texts hold nothing."""

    def __init__(self, spark: SparkSession, path: str, key: str, columns: Sequence[str], parts: int = 64):
        self.spark, self.path, self.columns, self.parts = spark, path, list(columns), parts
        fields = ", ".join(f"{c} string" for c in columns)
        self.rows = Keyed(spark, f"{path}/rows", f"{key} long, {fields}", key, parts)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("gram"), F.lit(self.parts)).cast("int")

    def build(self, rows: DataFrame) -> None:
        """The index anew."""
        self.rows.create(rows)
        of = F.array_distinct(F.flatten(F.array(*[_grams(F.coalesce(c, F.lit(""))) for c in self.columns])))
        postings = self.rows.read().select(F.col(self.rows.key).alias("key"), F.explode(of).alias("gram")).select("gram", "key", self._part().alias("part"))
        deleted(self.spark, f"{self.path}/postings")
        # a frequent trigram's postings are spread over several files of its folder
        postings.hint("rebalance", "part").sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{self.path}/postings")

    def search(self, term: str | None) -> DataFrame:
        """The rows with the term in any of the columns, whatever its case; a blank term finds all."""
        term = (term or "").strip().lower()
        grams = sorted({term[i : i + 3] for i in range(len(term) - 2)})
        if not grams:
            return searched(self.rows.read(), term, self.columns)
        asked = self.spark.createDataFrame([(g,) for g in grams], "gram string")
        paths = [f"{self.path}/postings/part={r.part}" for r in asked.select(self._part().alias("part")).distinct().collect()]
        if not all(exists(self.spark, p) for p in paths):
            return self.rows.read().limit(0)  # some trigram has no row at all
        postings = self.spark.read.schema(_POSTINGS).parquet(*paths).where(F.col("gram").isin(grams))
        keys = postings.groupBy("key").count().where(F.col("count") == len(grams)).select(F.col("key").alias(self.rows.key))
        found = self.rows._read(self.rows._parts_of(keys)).join(keys, self.rows.key, "left_semi")
        return searched(found, term, self.columns)
