"""Connected components, and decisions that run through a component in order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, stored

#: Links that one task settles at most, about.
MOST = 500_000


def components(links: DataFrame) -> DataFrame:
    """
    (id, component) of the nodes of `links` (a, b; a < b): the least node reachable. In turns every node hands its least
    neighbour to its greater ones, and to its lesser ones; both are a minimum by key and a join with it, and rounds grow
    with the logarithm of the longest way.
    """
    links, before = stored(links.select("a", "b").distinct(), "links"), None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        handed = both.where("b > a").join(least, "a").select(F.col("least").alias("a"), "b")
        handed = stored(handed.where("a < b").distinct(), "links")
        # now each node has lesser neighbours only to choose from
        least = handed.groupBy("b").agg(F.min("a").alias("least"))
        chosen = handed.join(least, "b").select(F.least("a", "least").alias("x"), F.greatest("a", "least").alias("y")).where("x < y")
        after = stored(chosen.unionByName(least.select(F.col("least").alias("x"), F.col("b").alias("y"))).distinct().toDF("a", "b"), "links")
        discard(links, handed)
        links, now = after, after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(links.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
        before = now


def _greedy(t: pa.Table) -> pa.Table:
    """The nodes that have a taken neighbour before them, of one component's links."""
    a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
    order = np.lexsort((a, b))
    rejected: set[int] = set()
    for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
        if x not in rejected:  # all links to x stand before, as x < y
            rejected.add(y)
    return pa.table([pa.array(sorted(rejected), pa.int64())], names=["id"])


def rejected(links: DataFrame, most: int = MOST) -> DataFrame:
    """
    (id) of the nodes that are not taken when nodes, in their order, are taken unless a neighbour taken before is there.
    `links`: a, b; a < b. Up to `most` links are settled in one task, and of more each component in one. A component with more
    links than `most` is settled up to the node that about so many of its links lead to or stay below, which settles the
    neighbours of what was taken, too; the rest falls into components anew. So rounds grow with the links of the largest
    component by `most`, not with its length.
    """
    open_, out = stored(links.select("a", "b").distinct(), "open"), None
    while n := open_.count():
        if n <= most:
            found = stored(open_.withColumn("all", F.pmod("a", F.lit(1))).groupBy("all").applyInArrow(_greedy, "id long"), "rejected")
            return found if out is None else out.unionByName(found)
        united = stored(components(open_), "united")
        of = stored(open_.join(united.withColumnRenamed("id", "a"), "a"), "open")
        large = stored(of.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most), "large")
        all_small = large.isEmpty()
        if not all_small:
            # of each of these components the quantile of links by their later node that leaves about `most` before it
            quantiles = of.join(large, "component").groupBy("component", "n").agg(F.percentile_approx("b", F.array(*[F.lit(2.0**-k) for k in range(17)]), 200_000).alias("q"))
            halvings = F.least(F.ceil(F.log2(F.col("n") / most)), F.lit(16)).cast("int")
            of = of.join(stored(quantiles.select("component", F.element_at("q", halvings + 1).alias("until")), "until"), "component", "left")
        else:
            of = of.withColumn("until", F.lit(None).cast("long"))
        part = of.where(F.col("until").isNull() | (F.col("b") <= F.col("until")))
        found = stored(part.select("component", "a", "b").groupBy("component").applyInArrow(_greedy, "id long"), "rejected")
        out = found if out is None else out.unionByName(found)
        if all_small:
            return out
        rest = of.where(F.col("b") > F.col("until"))
        gone = found.select(F.col("id").alias("a"), F.lit(True).alias("gone"))
        early = rest.where(F.col("a") <= F.col("until")).join(gone, "a", "left").where("gone IS NULL").select(F.col("b").alias("id")).distinct()
        early = stored(early, "rejected")
        out = out.unionByName(early)
        left = rest.where(F.col("a") > F.col("until")).select("a", "b")
        for side in ("a", "b"):
            left = left.join(early.withColumnRenamed("id", side), side, "left_anti")
        before, open_ = open_, stored(left, "open")
        discard(before)
    return out if out is not None else open_.select(F.col("a").alias("id"))
