"""
SimHash fingerprints: the weighted hashes of a text's terms vote on signed bits; permuted block tables find all
fingerprints within a chosen Hamming radius, and tell for each how many rows have one.

Terms are the words in lower case (A-Z only). A term weighs 1 + ln(count), times a share that grows with its length up
to six bytes, so that short function words do not drown the rest. Fingerprints have 128 bits; the query writes them in hex.

The search: of radius + spare blocks of bits at least `spare` are equal in two fingerprints within the radius, so each
choice of `spare` blocks is a table, which brings those bits to the front as a key. Rows of one fingerprint are a class, and
classes meet in the buckets of a key, dealt to tiles of at most 2 x TILE of them. A pair that several tables find counts in
the first. Tiles add up counts, so pairs are never rows, however many fingerprints lie close to each other.

A null text is an empty one; a text without words votes for nothing and has the fingerprint of zeros only. Equal texts
have equal fingerprints. Documents are in order of doc_id, then text, a null id first; repeated rows follow each other.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, stored

BITS = 128
#: Bits in which fingerprints may differ, and how many blocks more than that there are: four tables with keys of 32 bits.
RADIUS, SPARE = 3, 1
TILE = 1024
#: Where doc_id is null; smaller than any other.
NO_ID = -(2**63)


def fingerprint(text: str | None) -> bytes:
    counts = Counter(text.encode().lower().split()) if text else {}
    if not counts:
        return bytes(BITS // 8)
    bits = np.unpackbits(np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, counts)), np.uint8).reshape(-1, BITS // 8), axis=1)
    log = math.log
    weight = np.array([(1 + log(c)) * min(len(w), 6) ** 2 for w, c in counts.items()], np.float32)
    return np.packbits(weight @ bits.astype(np.float32) * 2 > weight.sum()).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """
    part, tail, doc_id, text: rows dealt by ranges of doc_id and sorted. After the rows of a part stands, as its tail,
    a copy of the first row of the next part (of the last part: of the first), so that each row's successor follows it.
    The driver sees the ranges' limits and first ids only, `parts` of each.
    """
    raw = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    ids = raw.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"))
    inner = sorted(set(ids.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
        if not inner:  # an empty table, or one part
            return rows.withColumn("part", F.lit(0))
        cut = Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol="at", outputCol="part")
        return cut.transform(rows.withColumn("at", F.col("doc_id").cast("double"))).withColumn("part", F.col("part").cast("int"))

    first = {r.part: r.first for r in placed(ids).groupBy("part").agg(F.min("doc_id").alias("first")).collect()}
    order = sorted(first)
    before = {first[p]: q for p, q in zip(order, [*order[-1:], *order[:-1]], strict=True)}
    own = placed(raw).select("part", F.lit(False).alias("tail"), "doc_id", "text")
    if not before:
        return own.repartition(parts, "part").sortWithinPartitions("part", "tail", "doc_id", "text")
    # the few first rows are found by the ids as they stand in the files, so that the scan skips what has none of them
    heads = raw.where(F.col("doc_id").isin([i for i in before if i != NO_ID]) | (F.col("doc_id").isNull() if NO_ID in before else F.lit(False)))
    to = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("doc_id")]
    tails = heads.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).select(to.alias("part"), F.lit(True).alias("tail"), "doc_id", "text")
    return own.unionByName(tails).repartition(parts, "part").sortWithinPartitions("part", "tail", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next document's, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints_with_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_text", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, size = None, [], 0
        for batch in batches:
            for part, tail, i, text in zip(*(batch.column(k) for k in range(4)), strict=True):
                part, tail, i, text = part.as_py(), tail.as_py(), i.as_py(), text.as_py() or ""
                if held is not None and held[0] == part:
                    new = edited(held[2], text)
                    mark, now = fingerprint(new), fingerprint(text)
                    out.append((None if held[1] == NO_ID else held[1], len(held[2]), new, held[3], mark, likeness(held[3], mark), likeness(held[3], now)))
                    size += len(new)
                else:
                    now = fingerprint(text)
                held = None if tail else (part, i, text, now)  # of tails of one id the first is the successor
                if size > 16e6 or len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_next(docs, parts).mapInArrow(run, "doc_id long, n_chars long, edited_text string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x.as_py()) for x in b.column(1)], pa.binary())], names=["doc_id", "fingerprint"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint binary")


def _words(marks: pa.Array) -> np.ndarray:
    """Fingerprints as rows of unsigned 64-bit words."""
    return np.frombuffer(b"".join(marks.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _masks(blocks: int) -> np.ndarray:
    """Which bits each block has, in the words of a fingerprint."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    bits = np.zeros((blocks, BITS), np.uint8)
    for row, a, b in zip(bits, edges, edges[1:], strict=False):
        row[a:b] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def permuted(distinct: DataFrame, radius: int, spare: int) -> DataFrame:
    """place (of the table), key, fingerprint, n: a row for each table."""
    masks = _masks(radius + spare)
    tables = [np.bitwise_or.reduce(masks[list(chosen)]) for chosen in combinations(range(radius + spare), spare)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = _words(b.column(0))
            for place, mask in enumerate(tables):
                own = words & mask
                key = np.bitwise_xor.reduce(mixed(own + np.arange(1, own.shape[1] + 1, dtype=np.uint64)), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), place, np.int32)), pa.array(key.view(np.int64)), b.column(0), b.column(1)], names=["place", "key", "fingerprint", "n"])

    return distinct.select("fingerprint", "n").mapInArrow(run, "place int, key long, fingerprint binary, n long")


def _tile_counts(radius: int, spare: int):
    masks, chosen = _masks(radius + spare), list(combinations(range(radius + spare), spare))

    def count(t: pa.Table) -> pa.RecordBatch:
        """fingerprint, near: of whole tiles, sorted by tile, how many rows each fingerprint's neighbours have."""
        words, n = _words(t.column("fingerprint")), t.column("n").to_numpy()
        tile = np.stack([t.column(c).to_numpy() for c in ("place", "key", "low", "high")], 1)
        group = np.concatenate([[0], np.cumsum((tile[1:] != tile[:-1]).any(1))])
        own, near = t.column("own").to_numpy(), np.zeros(len(n), np.int64)
        x = np.arange(len(n))
        for step in range(1, len(n)):
            x = x[x + step < len(n)]
            x = x[group[x] == group[x + step]]
            if not len(x):
                break
            y = x + step
            differ = words[x] ^ words[y]
            found = (np.bitwise_count(differ).sum(1) <= radius) & ((tile[x, 2] == tile[x, 3]) | (own[x] != own[y]))
            a, b, differ = x[found], y[found], differ[found]
            equal = ((differ[:, None, :] & masks) == 0).all(2)
            first = np.stack([equal[:, list(c)].all(1) for c in chosen], 1).argmax(1) if len(a) else a
            a, b = a[first == tile[a, 0]], b[first == tile[a, 0]]
            np.add.at(near, a, n[b])
            np.add.at(near, b, n[a])
        some = near > 0
        return pa.RecordBatch.from_arrays([t.column("fingerprint").combine_chunks().filter(pa.array(some)), pa.array(near[some])], names=["fingerprint", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])]).combine_chunks()
            if not t.num_rows:
                continue
            tile = np.stack([t.column(c).to_numpy() for c in ("place", "key", "low", "high")], 1)
            begin = int(np.flatnonzero((tile != tile[-1]).any(1))[-1]) + 1 if (tile != tile[-1]).any() else 0
            if begin:
                yield count(t.slice(0, begin))
            held = t.slice(begin)  # the last tile may go on in the next batch
        if held is not None:
            yield count(held)

    return run


def within_radius(marks: DataFrame, radius: int = RADIUS, spare: int = SPARE) -> DataFrame:
    """
    fingerprint, n, near: for each class of `marks` (column fingerprint, binary) how many rows it has, and how many rows have
    another fingerprint at most `radius` bits away. Classes of one row without neighbours are left out.
    """
    distinct = stored(marks.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.count("*").alias("n")), "classes")
    keyed = permuted(distinct, radius, spare)
    # stored, so that the join with it splits the keys that many fingerprints have
    sizes = stored(keyed.groupBy("place", "key").agg(F.count("*").alias("m")).where("m > 1").select("place", "key", F.ceil(F.col("m") / TILE).cast("int").alias("tiles")), "sizes")
    rows = keyed.join(sizes, ["place", "key"]).withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tile = ["place", "key", "low", "high"]
    rows = rows.select("place", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "fingerprint", "n")
    found = rows.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(_tile_counts(radius, spare), "fingerprint binary, near long")
    near = found.groupBy("fingerprint").agg(F.sum("near").alias("near"))
    out = distinct.join(near, "fingerprint", "left").select("fingerprint", "n", F.coalesce("near", F.lit(0)).alias("near"))
    return out.where("n > 1 OR near > 0")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """`n_near`: how many other documents have a fingerprint at most RADIUS bits away."""
    out = fingerprints_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    edited_ = F.unhex(F.sha2(F.col("edited_text"), 256)).alias("edited")
    rows = stored(out.select("doc_id", "n_chars", edited_, "fingerprint", "edited_fingerprint", "near_edited", "near_next"), "fingerprints")
    near = stored(within_radius(rows.select("fingerprint")), "near")
    text = lambda c: F.lower(F.hex(c))
    n_near = F.coalesce(F.col("n") - 1 + F.col("near"), F.lit(0)).alias("n_near")
    return rows.join(near, "fingerprint", "left").select("doc_id", "n_chars", text("edited").alias("edited_sha256"), text("fingerprint").alias("fingerprint"), text("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next", n_near)
