"""Digests and seen keys, batch by batch over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.operators.relational import first_by_key
from newsloom.operators.seen import SeenKeys
from newsloom.operators.storage import deleted, folders, shared_dir, stored
from newsloom.sources.tables import table

from .registry import query

HOURS, EVERY = 2160, 720
_STEP, _SPAN = EVERY * 3_600_000_000, HOURS * 3_600_000_000


@query("x5_digest_stream", f"""
WITH a AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) AS t FROM orders WHERE o_orderstatus = 'F'),
c AS (SELECT id, t, unnest(range((t + {_STEP - 1}) // {_STEP}, (t + {_SPAN}) // {_STEP} + 1)) * {_STEP} AS d FROM a),
p AS (SELECT l_orderkey AS id, epoch_us(l_shipdate) AS t FROM lineitem WHERE l_returnflag = 'R'),
mark AS (SELECT least((SELECT max(d) FROM c), (SELECT max(t) FROM p)) - 3600000000 AS m)
SELECT d AS digest_us, id, place FROM (SELECT d, id, row_number() OVER (PARTITION BY d ORDER BY t DESC, id) AS place FROM c, mark
  WHERE d <= m AND NOT EXISTS (SELECT 1 FROM p WHERE p.id = c.id AND p.t BETWEEN c.d - {_SPAN} AND c.d)) WHERE place <= 5""")
def digest_stream(spark, sf):
    """Each digest that the watermark has passed, by streams over the files of articles and jobs."""
    from newsloom.streaming.digest import digests, run_digests

    def stream(name):  # as a pattern the path may be a file or a folder
        return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")

    articles = stream("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("published_at"))
    posts = stream("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("article_id"), F.col("l_shipdate").alias("posted_at"))
    at = f"{shared_dir(spark)}/newsloom-digests-{uuid.uuid4().hex}"
    run_digests(spark, articles, posts, f"{at}/left", f"{at}/checkpoint", HOURS, EVERY)
    return digests(spark, f"{at}/left").select(F.unix_micros("digest_at").alias("digest_us"), "id", F.col("place").cast("long").alias("place"))


@query("x2_seen_keys", "SELECT y AS batch, source_key, article_id FROM (SELECT year(l_shipdate)::INT AS y, l_partkey || '/' || l_suppkey AS source_key, l_orderkey AS article_id, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY year(l_shipdate), l_orderkey, l_linenumber) AS r FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL) WHERE r = 1")
def seen_keys(spark, sf):
    """Line items come year by year; of each key the first is taken, once over all years."""
    rows = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("batch"), F.concat_ws("/", "l_partkey", "l_suppkey").alias("source_key"), F.col("l_orderkey").alias("article_id"), "l_linenumber").where("batch IS NOT NULL AND l_partkey IS NOT NULL AND l_suppkey IS NOT NULL")
    at = f"{shared_dir(spark)}/newsloom-seen-{uuid.uuid4().hex}"
    # dealt to the years once, so that a year reads its own lines
    rows.write.option("compression", "zstd").partitionBy("batch").parquet(f"{at}/came")
    came, seen, taken = spark.read.schema(rows.schema).parquet(f"{at}/came"), SeenKeys(spark, f"{at}/keys"), None
    for year in sorted(int(n.removeprefix("batch=")) for n in folders(spark, f"{at}/came") if n.startswith("batch=")):
        of_year = came.where(F.col("batch") == year)
        firsts = first_by_key(of_year, ["source_key"], ["article_id", "l_linenumber"])
        fresh = stored(firsts.join(seen.near(of_year, "source_key", f"{year}"), "source_key", "left_anti"), "taken")
        seen.add(fresh, "source_key", f"{year}", once=True)
        taken = fresh if taken is None else taken.unionByName(fresh)
    none = rows.limit(0) if taken is None else taken
    deleted(spark, at)
    return none.select("batch", "source_key", "article_id")
