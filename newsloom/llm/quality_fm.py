"""
Quality classifier: a factorisation machine over hashed words, structure statistics and metadata. Pairwise interactions
have rank FACTORS and are scored in linear time: half the sum over factors of (sum v x)^2 - sum (v x)^2.

It learns from at most SAMPLE labelled rows, those of least hash of doc_id. SHARDS tasks learn by themselves for an epoch
at a time and their weights are averaged, ROUNDS times; a shard has at most a few thousand rows of features, whatever the
texts' lengths, as each row has at most WORD_PLACES places.

Scores are probabilities of label 1. Null and empty texts have statistics of zero and are scored like any. Of several
labels of one document the mean counts, rounded up; null labels don't count. Without any labels every score is 0.5. Rows
are scored one by one, so repeated rows get equal scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, release_memory, spread, stored

WORD_PLACES = 1 << 14
BINS = 10
STATISTICS = 14
META_PLACES = 256
PLACES = WORD_PLACES + STATISTICS * BINS + STATISTICS + META_PLACES
FACTORS = 6
SAMPLE = 16_000
SHARDS = 8
ROUNDS = 6
BATCH = 128
STEPS = 12
RATE = 0.08
DECAY = 1e-5
TEST_MODULUS = 5
KEEP = 0.3

_UPPER, _DIGIT = bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A))
_PLAIN = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum() or chr(b).isspace())
_HIGH, _SPACE = bytes(range(0x80, 0x100)), b" \t\n\r\x0b\x0c"


def statistics(raw: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Shares and logarithms of the text's structure, all about 0 to 1."""
    n, size = len(words), max(len(raw), 1)
    if not n:
        return [0.0] * STATISTICS
    gone = lambda drop: (len(raw) - len(raw.translate(None, drop))) / size
    tops = counts.most_common(3)
    shapes = Counter(w[-2:] for w in words)
    marked = sum(c for s, c in shapes.items() if len(s) == 2 and not s.translate(None, _PLAIN) == b"" and len(s.translate(None, _PLAIN)) == 2)
    lines = raw.split(b"\n")
    return [
        min(math.log1p(n) / 10, 1), len(counts) / n, tops[0][1] / n, sum(c for _, c in tops) / n, min(sum(map(len, words)) / n / 20, 1),
        min(4 * gone(_UPPER), 1), min(10 * gone(_DIGIT), 1), 1 - len(raw.translate(None, bytes(set(range(256)) - set(_PLAIN)))) / size,
        gone(_HIGH), marked / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(set(zip(words, words[1:], strict=False))) / n, min(len(lines) / n * 5, 1), len(set(lines)) / len(lines),
    ]


def features(text: str | None, metadata: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places and values."""
    raw = text.encode() if text else b""
    words = raw.split()
    counts = Counter(raw.lower().split())
    at = np.fromiter(map(xxhash.xxh3_64_intdigest, counts), np.uint64, len(counts)).astype(np.int64) & (WORD_PLACES - 1)
    value = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    dense = np.bincount(at, value, WORD_PLACES) if len(at) else np.zeros(WORD_PLACES)
    at = np.flatnonzero(dense)
    value = dense[at] / max(float(np.sqrt((dense[at] ** 2).sum())), 1e-9)
    stats = np.array(statistics(raw, words, counts))
    k = np.arange(STATISTICS)
    bins = WORD_PLACES + k * BINS + np.minimum((stats * BINS).astype(int), BINS - 1)
    plain = WORD_PLACES + STATISTICS * BINS + k
    meta = [PLACES - META_PLACES + xxhash.xxh3_64_intdigest(f"{i}={m}") % META_PLACES for i, m in enumerate(metadata)]
    return np.concatenate([at, bins, plain, meta]).astype(np.int32), np.concatenate([value, np.full(STATISTICS, 0.5), stats, np.full(len(meta), 0.5)]).astype(np.float32)


class Weights:
    """w0, w and v of the machine in one array: place p has w in column 0 and v in the others; w0 is the last row's first."""

    def __init__(self, all_: np.ndarray):
        self.all = all_

    @staticmethod
    def fresh() -> Weights:
        w = np.random.default_rng(7).normal(0, 0.05, (PLACES + 1, 1 + FACTORS)).astype(np.float32)
        w[:, 0] = 0
        w[-1] = 0
        return Weights(w)

    def raw(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = self.all[at]
        vx = own[:, 1:] * x[:, None]
        sums = np.add.reduceat(vx, starts)
        out = self.all[-1, 0] + np.add.reduceat(own[:, 0] * x, starts) + 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(1)
        return out, sums, vx

    def learn(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int) -> None:
        """An epoch of batches with AdaGrad steps on the logistic loss; over few rows, as many epochs as make STEPS batches."""
        draw = np.random.default_rng(seed)
        order = np.concatenate([draw.permutation(len(rows)) for _ in range(max(1, -(-STEPS * BATCH // max(len(rows), 1)) if len(rows) < STEPS * BATCH else 1))])
        squares = np.full(self.all.shape, 1e-2, np.float32)
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            at, x = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own])
            sizes = np.array([len(rows[i][0]) for i in own])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            out, sums, vx = self.raw(at, x, starts)
            g = (1 / (1 + np.exp(-out)) - y[own]).astype(np.float32) / len(own) * 8
            each = np.repeat(g, sizes) * x
            used, inverse = np.unique(at, return_inverse=True)
            step = np.empty((len(used), 1 + FACTORS), np.float32)
            step[:, 0] = np.bincount(inverse, each, len(used))
            spread = np.repeat(sums, sizes, axis=0) - vx
            for f in range(FACTORS):
                step[:, 1 + f] = np.bincount(inverse, each * spread[:, f], len(used))
            step += DECAY * self.all[used]
            squares[used] += step**2
            self.all[used] -= RATE * step / np.sqrt(squares[used])
            squares[-1, 0] += g.sum() ** 2
            self.all[-1, 0] -= RATE * g.sum() / math.sqrt(squares[-1, 0])


def _row(at: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(at, np.int32), np.frombuffer(x, np.float32)


def fit(docs: DataFrame, labels: DataFrame, meta: Column, sample: int = SAMPLE, rounds: int = ROUNDS) -> Weights | None:
    """`labels`: doc_id and quality of the rows to learn from. None without any."""
    spark = docs.sparkSession
    known = labels.select(labels["doc_id"].cast("long").alias("id"), labels["quality"].cast("double").alias("q")).dropna().groupBy("id").agg((F.avg("q") >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # at most `sample` pairs of numbers: broadcast
    found = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), meta.alias("meta")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    # of rows with one id the least by text and metadata: `sample` bounds the rows, too
    rows = found.groupBy("doc_id", "y").agg(F.min(F.struct("text", "meta")).alias("row")).select("doc_id", "row.text", "row.meta", "y")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t.as_py(), m.as_py()) for t, m in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())], names=["doc_id", "y", "places", "weights"])

    made = rows.select("doc_id", "text", "meta", "y").mapInArrow(make, "doc_id long, y int, places binary, weights binary")
    table = stored(made.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int")), "features")
    weights, any_ = Weights.fresh().all, False
    for r in range(rounds):
        now = spark.sparkContext.broadcast(weights)

        def learn(rows: pa.Table, now=now, r=r) -> pa.Table:
            own = Weights(now.value.copy())
            order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
            at, x = rows.column("places").to_pylist(), rows.column("weights").to_pylist()
            own.learn([_row(at[i], x[i]) for i in order], rows.column("y").to_numpy()[order], r)
            return pa.table([pa.array([len(order)], pa.int64()), pa.array([own.all.tobytes()], pa.binary())], names=["n", "w"])

        # one array of fixed size from each of SHARDS tasks
        found = table.groupBy("shard").applyInArrow(_of_one(learn), "n long, w binary").collect()
        if not found:
            return None
        total = sum(f.n for f in found)
        weights = sum(np.frombuffer(f.w, np.float32).reshape(weights.shape) * np.float32(f.n / total) for f in found)
        any_ = True
        now.unpersist()
    return Weights(weights) if any_ else None


def _of_one(f):
    return lambda rows: f(rows)


def scorer(spark, weights: Weights | None):
    """A column function: (text, metadata array) to the probability of label 1."""
    shared = spark.sparkContext.broadcast(weights.all if weights else None)

    @F.arrow_udf("double")
    def score(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = Weights(shared.value) if shared.value is not None else None
        for text, meta in parts:
            out = np.full(len(text), 0.5)
            for a in range(0, len(text) if own else 0, 256):
                rows = [features(t.as_py(), m.as_py()) for t, m in zip(text[a : a + 256], meta[a : a + 256], strict=True)]
                starts = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])[:-1]]).astype(np.int64)
                raw, _, _ = own.raw(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), starts)
                out[a : a + len(rows)] = 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))
            yield pa.array(out, pa.float64())
        release_memory()

    return score


def _meta(docs: DataFrame, metadata: Sequence[str], magnitudes: Sequence[str]) -> Column:
    """Metadata as strings; of numbers in `magnitudes` the order of magnitude only."""
    parts = [docs[m].cast("string") for m in metadata] + [F.floor(F.log2(docs[m].cast("double") + 1)).cast("string") for m in magnitudes]
    return F.array(*[F.coalesce(p, F.lit("")) for p in parts]).cast("array<string>")


def quality(docs: DataFrame, labels: DataFrame, metadata: Sequence[str] = (), magnitudes: Sequence[str] = ("n_chars",), test_modulus: int = TEST_MODULUS) -> Column:
    """Learns from labels of rows with fold(test_modulus) > 0; a column over `docs` with the score of each row."""
    meta = _meta(docs, metadata, magnitudes)
    return scorer(docs.sparkSession, fit(docs, labels.where(fold(test_modulus) > 0), meta))(docs["text"].cast("string"), meta)


def op2_quality_fm(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars"))
    out = docs.select("doc_id", (fold(TEST_MODULUS) == 0).alias("held_out"), quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).alias("score"))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= KEEP, 1).otherwise(0).alias("predicted"))
