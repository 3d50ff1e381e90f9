"""
Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of WINDOW words (a shorter item is one window). Shingles are single words, ordered by
rarity over all documents; containment of a window is exact, so one shingle is the necessary prefix: its rarest word.
Document words meet the windows whose prefix they are; the prefix's place gives the only start the window can have
there, which must leave room for it on both sides (positional and length bounds); then the words themselves are compared.

The windows are broadcast only while the benchmark has at most BROADCAST_BYTES of text. Beyond that, words and windows
are joined by shuffles, whose hot words Spark's skew join splits, and candidates meet the texts by their key.

Words are runs of a-z, 0-9 and characters beyond ASCII, A-Z in lower case. Null and empty texts have none and are clean;
repeated rows (equal doc_id and text) are searched as one and give a row each; items with equal windows all count. Items without an id
count as one item, which no list of ids shows. Without documents there are no rows, without items no hits; further columns are left out
(the stage keeps them). Texts of any length are searched whole: a row for each of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread, stored

WINDOW = 10
#: The most benchmark text whose windows are broadcast; a window takes some ten times its share of it.
BROADCAST_BYTES = 4_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Splitting leaves an empty string before a leading gap and after a trailing one."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS), "")


def windows_of(bench: DataFrame, width: int) -> DataFrame:
    """window (words), items: distinct windows with the items that have them, as sorted strings."""
    items = bench.select(bench["item_id"].cast("string").alias("item"), words_of(bench["text"].cast("string")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    each = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(width)))).alias("window"))
    # structs, as a set of plain values leaves null out
    return each.groupBy("window").agg(F.transform(F.collect_set(F.struct("item")), lambda x: x["item"]).alias("items"))


def with_prefix(windows: DataFrame, docs: DataFrame, small: bool) -> DataFrame:
    """prefix (the rarest word in the documents; of equals the lesser), offset, window, items."""
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    vocabulary = F.broadcast(vocabulary) if small else vocabulary
    spoken = docs.select(F.explode(words_of(F.col("text"))).alias("word"))
    counts = spoken.join(vocabulary, "word", "left_semi").groupBy("word").count()
    # as few as the vocabulary; or stored, so that the join splits words which many windows have
    counts = F.broadcast(counts) if small else stored(counts, "counts")
    places = windows.select("window", "items", F.posexplode("window").alias("offset", "word"))
    ranked = places.join(counts, "word", "left").groupBy("window", "items").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "word", "offset")).alias("least"))
    return ranked.select(F.col("least.word").alias("prefix"), F.col("least.offset").alias("offset"), "window", "items")


def hits(docs: DataFrame, bench: DataFrame, width: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """
    doc_id, text_hash, n_words, copies, found array<struct<start,length,items>>: one row for each distinct (doc_id, text),
    how many rows have it, and the places (from 1) where windows occur.
    """
    docs = spread(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")))
    small = (bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= broadcast_bytes
    windows = stored(with_prefix(windows_of(bench, width), docs, small), "windows")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("w"))
    start = F.col("at") - F.col("offset") + 1
    bounds = (start >= 1) & (start + F.size("window") - 1 <= F.col("n_words"))
    same = F.slice("w", F.greatest(start, F.lit(1)), F.size("window")) == F.col("window")
    place = F.struct(start.alias("start"), F.size("window").alias("length"), "items")
    key = ["doc_id", "text_hash"]
    if small:
        # the empty word stands at each text's end, so that every document has a row, and counts repeated rows
        end = windows.sparkSession.range(1).select(F.lit("").alias("prefix"), F.lit(None).cast("int").alias("offset"), F.lit(None).cast("array<string>").alias("window"), F.lit(None).cast("array<string>").alias("items"))
        spoken = texts.select(*key, "w", F.size("w").alias("n_words"), F.posexplode(F.concat("w", F.array(F.lit("")))).alias("at", "word"))
        found = spoken.join(F.broadcast(windows.unionByName(end)), (F.col("word") == F.col("prefix")) & (F.col("window").isNull() | (bounds & same)))
        found = found.select(*key, "n_words", F.when(F.col("window").isNotNull(), place).alias("place"))
        copies = F.count_if(F.col("place").isNull()).alias("copies")
        return found.groupBy(*key).agg(F.max("n_words").cast("long").alias("n_words"), copies, F.collect_set("place").alias("found"))
    texts = texts.groupBy(*key).agg(F.first("w").alias("w"), F.count("*").alias("copies")).withColumn("n_words", F.size("w"))
    spoken = texts.select(*key, "n_words", F.posexplode("w").alias("at", "word"))
    candidates = spoken.join(windows, (F.col("word") == F.col("prefix")) & bounds).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "at", "offset", "window", "items")
    own = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))
    found = texts.join(candidates, own).where(same).select(*key, place.alias("place"))
    found = found.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_set("place").alias("found"))
    none = F.array().cast(found.schema["found"].dataType)
    return texts.join(found, own, "left").select(*key, F.col("n_words").cast("long").alias("n_words"), "copies", F.coalesce("found", none).alias("found"))


def contaminated_keys(found: DataFrame) -> DataFrame:
    """contaminated_id, contaminated_hash of the texts with hits, once each. A row has them by its doc_id and the hash of its text."""
    return found.where(F.size("found") > 0).select(F.col("doc_id").alias("contaminated_id"), F.col("text_hash").alias("contaminated_hash"))


def without_contaminated(docs: DataFrame, bench: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of `docs`, all columns, whose texts hold no window of an item; a row's own text counts, whatever its id."""
    gone = contaminated_keys(hits(docs, bench, width))
    own = docs["doc_id"].cast("long").eqNullSafe(gone["contaminated_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["contaminated_hash"])
    return docs.join(gone, own, "left_anti")


def report(found: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items, contaminated: a row for each row of the documents."""
    spans = F.array_sort(F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))))
    grown = lambda acc, x: F.struct(
        F.greatest(acc["to"], x["start"] + x["length"]).alias("to"),
        (acc["n"] + F.greatest(x["start"] + x["length"] - F.greatest(acc["to"], x["start"]), F.lit(0))).alias("n"),
    )
    n_hit = F.aggregate(spans, F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")), grown)["n"].cast("long")
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda x: x["items"]))))
    out = found.select("doc_id", "text_hash", "n_words", "copies", n_hit.alias("n_hit"), items.alias("items"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "text_hash", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = report(hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i+9], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
spot AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, i, n, item_id FROM spot JOIN win USING (n, s)),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit), range(0, 10) t(k) WHERE k < n GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
"""
