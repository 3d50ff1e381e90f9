"""
Language ID by string kernels: the blended-spectrum presence kernel counts the distinct character n-grams, n from 1 to
4, that two texts share, each length with its weight, normalised to one for equal texts. A bounded sample of labelled
rows (SAMPLE rows in all) gives Nystroem landmarks (LANDMARKS of them) and a one-versus-rest kernel ridge regression,
whose normal equations are summed up on the executors. A text's scores are one matrix product of its presence vector
with the landmarks, the landmarks' whitening and the ridge weights multiplied out, as all three are linear.

N-grams are of the text in lower case, hashed to 2**14 places for each length. Languages are those of the sample. A null
text, or one without letters (characters of category L), is `und` with score 0. With no labelled rows every text is `und`.
Rows are scored one by one; of ties between languages the first in alphabetical order stays. A doc_id is learnt from once:
of repeated rows, or of several with one id, its least language and the least text with that count. Null ids are held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fold, spread, stored

ORDERS = (1, 2, 3, 4)
#: Weight of each length's shared n-grams in the blend.
BLEND = (0.25, 0.5, 1.0, 1.0)
PLACES = 1 << 14
SAMPLE = 6000
LANDMARKS = 256
RIDGE = 1e-3
TEST_MODULUS = 5
LETTER = regex.compile(r"\p{L}")
#: Texts of one matrix product.
BATCH = 64
#: Tasks that sum up the normal equations of the sample.
PARTS = 8


def presence(text: str) -> np.ndarray:
    """Sorted places of the n-grams that occur in the text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    seen = np.zeros(len(ORDERS) * PLACES, bool)
    h = np.zeros(len(points), np.uint64)
    for k in range(len(ORDERS)):
        if len(points) <= k:
            break
        h = h[: len(points) - k] * np.uint64(0x100000001B3) + points[k:] + np.uint64(1)
        seen[(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)) & np.uint64(PLACES - 1)).astype(np.int64) + k * PLACES] = True
    return np.flatnonzero(seen)


WEIGHTS = np.repeat(np.array(BLEND, np.float32), PLACES)


class Presence:
    """A matrix of at most BATCH rows, used again for each batch: only what a batch has set is cleared."""

    def __init__(self, rows: int = BATCH):
        self.matrix = np.zeros((rows, len(WEIGHTS)), np.float32)

    def times(self, places: list[np.ndarray], right: np.ndarray) -> np.ndarray:
        """The product of the texts' presence vectors, each divided by its norm in the kernel, with `right`."""
        row = np.repeat(np.arange(len(places)), [len(p) for p in places])
        at = np.concatenate(places)
        self.matrix[row, at] = 1
        out = self.matrix[: len(places)] @ right
        self.matrix[row, at] = 0
        norms = np.sqrt(np.bincount(row, WEIGHTS[at], len(places)))
        return out / np.maximum(norms, 1e-9)[:, None]


class Model:
    """Languages, and the matrix that takes a presence vector to one score for each."""

    def __init__(self, langs: list[str], matrix: np.ndarray):
        self.langs, self.matrix = langs, matrix

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if self.langs and t and LETTER.search(t)]
        buffer = Presence() if known else None
        for a in range(0, len(known), BATCH):
            own = known[a : a + BATCH]
            raw = buffer.times([presence(texts[i]) for i in own], self.matrix)
            share = np.exp(4 * (raw - raw.max(1, keepdims=True)))
            best = raw.argmax(1)
            for i, k, x in zip(own, best.tolist(), (share[np.arange(len(own)), best] / share.sum(1)).tolist(), strict=True):
                lang[i], score[i] = self.langs[k], x
        return lang, score


def chosen_rows(docs: DataFrame, sample: int) -> list:
    """
    doc_id and lang of at most `sample` rows to learn from, with all languages alike: a row's hash, as a share of its
    language's number of ids, is the place it would have among them, and the first places of all languages are taken.
    Texts are not read.
    """
    ids = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    counts = stored(ids.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids")), "languages")
    sized = F.broadcast(counts) if counts.count() <= sample else counts
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    placed = ids.join(sized, "lang").select("doc_id", "lang", (share * F.col("ids")).alias("place")).where(F.col("place") <= 3.0 * sample)
    first = placed.groupBy("doc_id").agg(F.min(F.struct("lang", "place")).alias("x")).select("doc_id", "x.*")
    return first.orderBy("place", "lang", "doc_id").limit(sample).collect()


def places_of(docs: DataFrame, chosen: list, landmarks: int) -> DataFrame:
    """(doc_id, own, places, mark) of the chosen rows, a row for each id; `own` is the place of its language in order."""
    spark = docs.sparkSession
    langs = sorted({r.lang for r in chosen})
    wanted = spark.createDataFrame([(r.doc_id, r.lang, langs.index(r.lang), n < landmarks) for n, r in enumerate(chosen)], "id long, own_lang string, own int, mark boolean")
    rows = docs.join(F.broadcast(wanted), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("own_lang"))).where(F.col("text").isNotNull())
    rows = rows.groupBy("doc_id", "own", "mark").agg(F.min("text").alias("text"))

    def places(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([presence(x.as_py()).astype(np.int32).tobytes() for x in b.column(3)], pa.binary()), b.column(2)], names=["doc_id", "own", "places", "mark"])

    # at most `sample` rows of a bit for each place: bounded whatever the texts' lengths
    made = rows.mapInArrow(places, "doc_id long, own int, places binary, mark boolean")
    return stored(made.repartition(PARTS, "doc_id"), "places")


def fit(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """`docs`: doc_id, text, lang of the rows to learn from."""
    spark = docs.sparkSession
    chosen = chosen_rows(docs, sample)
    langs = sorted({r.lang for r in chosen})
    if not langs:
        return Model([], np.zeros((0, 0)))
    rows = places_of(docs, chosen, landmarks)
    marks = sorted(rows.where("mark").select("doc_id", "places").collect())
    land = np.zeros((len(marks), len(WEIGHTS)), np.float32)
    for row, r in zip(land, marks, strict=True):
        at = np.frombuffer(r.places, np.int32)
        row[at] = np.sqrt(WEIGHTS[at]) / max(float(np.sqrt(WEIGHTS[at].sum())), 1e-9)
    values, basis = np.linalg.eigh((land @ land.T).astype(np.float64))
    white = (basis / np.sqrt(np.maximum(values, 1e-6))).astype(np.float32)  # K^-1/2 up to a rotation
    shared = spark.sparkContext.broadcast(np.sqrt(WEIGHTS)[:, None] * (land.T @ white))
    width, n_langs = len(marks), len(langs)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, buffer = shared.value, Presence()
        gram, right = np.zeros((width, width)), np.zeros((width, n_langs))
        for b in batches:
            for at in range(0, len(b), BATCH):
                part = b.slice(at, BATCH)
                phi = buffer.times([np.frombuffer(p.as_buffer(), np.int32) for p in part.column(0)], features).astype(np.float64)
                y = -np.ones((len(part), n_langs))
                y[np.arange(len(part)), part.column(1).to_numpy()] = 1
                gram += phi.T @ phi
                right += phi.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], names=["gram", "right"])

    gram, right = np.zeros((width, width)), np.zeros((width, n_langs))
    for r in rows.select("places", "own").mapInArrow(equations, "gram binary, right binary").collect():  # matrices of fixed size from each of PARTS files
        gram += np.frombuffer(r.gram).reshape(gram.shape)
        right += np.frombuffer(r.right).reshape(right.shape)
    solved = np.linalg.solve(gram + ridge * len(chosen) * np.eye(width), right)
    model = Model(langs, (shared.value @ solved).astype(np.float32))
    shared.unpersist()
    discard(rows)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = shared.value.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return spread(docs.select("doc_id", "held_out", "text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, test_modulus: int = TEST_MODULUS) -> DataFrame:
    """Learns from text and lang of the rows with fold(test_modulus) > 0; predicts for all."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang")).withColumn("held_out", fold(test_modulus) == 0)
    return predict(rows, fit(rows.where(~F.col("held_out"))))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
