"""
Pages far from the front. Offset and limit keep all rows up to the page on the driver; here it holds one page.

Pages     rows dealt out by ranges of the order once; a page's place follows from the numbers of rows of the ranges before it
after     the page that follows a row already shown, by its key: for readers that go on from page to page

An order is a list of (column, descending); nulls come first either way, and the columns together are unique.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import discard, stored

Order = Sequence[tuple[str, bool]]


def _by(order: Order) -> list[Column]:
    return [F.col(c).desc_nulls_first() if down else F.col(c).asc_nulls_first() for c, down in order]


class Pages:
    """The rows of `df` by ranges, stored; close() removes them."""

    def __init__(self, df: DataFrame, order: Order, ranges: int = 64):
        self.order, self.columns = order, df.columns
        dealt = df.repartitionByRange(ranges, *_by(order)).withColumn("_range", F.spark_partition_id())
        self.table = stored(dealt, "pages")
        sizes = {r["_range"]: r["n"] for r in self.table.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # at most `ranges` numbers
        self.sizes = [sizes.get(k, 0) for k in range(ranges)]
        self.total = sum(self.sizes)

    def page(self, number: int, size: int) -> DataFrame:
        """Page `number` (from 1) in order; beyond the last one there is none. Only the ranges that it touches are sorted."""
        first = (max(1, number) - 1) * size
        ends = list(accumulate(self.sizes))
        touched = [(k, end - n) for k, (n, end) in enumerate(zip(self.sizes, ends, strict=True)) if n and end > first and end - n < first + size]
        if not touched:
            return self.table.select(*self.columns).limit(0)
        before = F.create_map(*[F.lit(x) for pair in touched for x in pair])
        place = F.row_number().over(Window.partitionBy("_range").orderBy(*_by(self.order))) + F.element_at(before, F.col("_range"))
        rows = self.table.where(F.col("_range").isin([k for k, _ in touched])).withColumn("_place", place)
        return rows.where((F.col("_place") > first) & (F.col("_place") <= first + size)).orderBy("_place").select(*self.columns)

    def close(self) -> None:
        discard(self.table)


def after(df: DataFrame, order: Order, last: Sequence, size: int) -> DataFrame:
    """The first `size` rows behind the one whose order columns are `last`."""
    beyond = F.lit(False)
    for k, ((c, down), v) in enumerate(zip(order, last, strict=True)):
        same = reduce(lambda a, b: a & b, [F.col(o).eqNullSafe(F.lit(x)) for (o, _), x in zip(order[:k], last[:k], strict=True)], F.lit(True))
        further = F.col(c).isNotNull() if v is None else (F.col(c) < F.lit(v)) if down else (F.col(c) > F.lit(v))
        beyond = beyond | (same & F.coalesce(further, F.lit(False)))
    return df.where(beyond).orderBy(*_by(order)).limit(size)
