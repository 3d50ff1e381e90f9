"""Helpers that the training-data operators share: columns, hashes of words, stored intermediate tables, packed blocks."""

from __future__ import annotations

import ctypes
import math
import weakref

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.storage import discard, shared_dir, spread, stored  # noqa: F401  the operators take them from here

U64 = np.uint64
#: Raw megabytes of text that one block holds, on average, while texts have up to GROWS_MB in all.
BLOCK_MB, GROWS_MB = 10, 10_000
#: Blocks whose requests one target answers.
PER_TARGET = 2


def id_and_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Only the key and the text, so that no extra column of `docs` can clash."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def fold(modulus: int) -> Column:
    """crc32 of the decimal doc_id modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+`: bytes.split() splits at just these six bytes."""
    words = text.encode().split() if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the constants are those of SplitMix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def window_hashes(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of each run of `width` consecutive word hashes, by doubling: a run is two shorter runs, which may overlap."""
    if len(h) < width:
        return np.empty(0, U64)
    at, out = 1, mixed(h + U64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    while at < width:
        step = min(at, width - at)
        out = mixed(out[: len(out) - step] * U64(0x9E3779B97F4A7C15) + out[step:] + U64(at))
        at += step
    return out


def sliding(x: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """pick over each `width` consecutive entries, in log2(width) steps."""
    at = 1
    while at < width:
        step = min(at, width - at)
        x = pick(x[: len(x) - step], x[step:])
        at += step
    return x


def among(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Whether each entry is in the sorted array `found`."""
    if not len(found):
        return np.zeros(len(x), bool)
    return found[np.minimum(np.searchsorted(found, x), len(found) - 1)] == x


def cuts(ordered: np.ndarray, targets: int) -> np.ndarray:
    """Where to cut sorted hashes so that equal ranges of the hash space go to each target."""
    edges = (np.arange(targets + 1, dtype=np.float64) * (2.0**64 / targets))[1:-1].astype(U64)
    return np.concatenate([[0], np.searchsorted(ordered, edges), [len(ordered)]])


def block_mb(total_mb: float) -> float:
    """
    Each block sends a row to each target, so rows would grow with the square of the input and shrink to nothing. From
    10 GB on, where a row has some 25 KB, blocks grow with the square root of the input instead (100 MB at 1 TB, 1 GB at
    100 TB): rows keep their size, and their number grows in proportion to the input.
    """
    return BLOCK_MB * math.sqrt(max(total_mb / GROWS_MB, 1))


def block_count(texts: DataFrame, text: str = "text") -> int:
    """Blocks of about block_mb() of text each; one pass over the text column, one number to the driver."""
    total = (texts.agg(F.sum(F.octet_length(text))).first()[0] or 0) / 1e6
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2, int(total / block_mb(total)), 1)


def target_count(n_blocks: int, per_target: int = PER_TARGET) -> int:
    """Parts of a table of hashes: each answers as many blocks' worth of requests as its memory allows."""
    return max(n_blocks // per_target, 1)


def packed_blocks(docs: DataFrame, n_blocks: int, keys: tuple[str | int, ...] = ("doc_id", "text")) -> DataFrame:
    """
    (block, payload): each row of `docs`, with all its columns, goes to the block that the hash of `keys` (names or places) names. A payload is a
    compressed Arrow stream, so that the one shuffle of the texts moves few and small rows. The result is dealt by
    block and persisted: the levels that follow meet it there without moving texts again. release() lets go of it.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key = F.pmod(F.xxhash64(*[F.col(f"c{n if isinstance(n, int) else names.index(n)}") for n in keys]), F.lit(n_blocks)).cast("int")

    def pack(batches):
        def flush(kept):
            t = pa.Table.from_batches(kept)
            blocks = t.column(0).to_numpy()
            order = np.argsort(blocks, kind="stable")
            found, begin = np.unique(blocks[order], return_index=True)
            out = []
            for a, b in zip(begin, [*begin[1:], len(order)], strict=True):
                part = t.take(pa.array(order[a:b])).drop_columns(["block"]).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(part)
                out.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(out, pa.binary())], names=["block", "payload"])

        kept, held = [], 0
        for b in batches:
            kept.append(b)
            held += b.nbytes
            if held > 32e6:
                yield flush(kept)
                kept, held = [], 0
        if kept and sum(map(len, kept)):
            yield flush([b for b in kept if len(b)])
        release_memory()

    packed = plain.select(key.alias("block"), "*").mapInArrow(pack, "block int, payload binary")
    out = packed.repartition(n_blocks, "block").sortWithinPartitions("block").persist(StorageLevel.MEMORY_AND_DISK)
    _PACKED.setdefault(out.sparkSession, []).append(out)
    return out


_PACKED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def release(spark: SparkSession) -> None:
    """Lets go of all packed blocks of a session. For when results that read them have been written."""
    for blocks in _PACKED.pop(spark, []):
        blocks.unpersist()


def release_memory() -> None:
    """Gives back what earlier blocks left free in this worker, which is used again for others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def unpacked(payloads: pa.ChunkedArray) -> pa.Table:
    release_memory()
    return pa.concat_tables([pa.ipc.open_stream(p.as_buffer()).read_all() for p in payloads])


def texts_of(payloads: pa.ChunkedArray, column: str):
    """The texts of a block one by one, in the order of unpacked()."""
    release_memory()
    for p in payloads:
        for batch in pa.ipc.open_stream(p.as_buffer()):
            for x in batch.column(column):
                yield x.as_py()


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()
