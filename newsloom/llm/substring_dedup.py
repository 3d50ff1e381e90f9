"""
Substring dedup by level-wise doubling: windows of words repeated at one length alone are extended to about twice that
length, until the wanted length is reached or no candidates survive.

A level never counts all windows. Of each full-length window it counts only the least of the shorter windows inside, by
hash (its anchor): equal full windows have equal anchors, so an anchor that occurs once rules out all windows it stands
for. At the last level the window is its own anchor, so the outcome is exact. Hashes of 64 bits are drawn anew at each
level; two different windows count as equal only if they collide at every level.

Texts are dealt once, as packed blocks; each level moves only the block's distinct anchors, as sorted arrays, to the
target that owns their range of hashes, and gets back those that repeat. A passage in all documents is one entry a block.

Nulls and empty texts have no words; texts shorter than a window lose nothing; a window repeated within one document
counts; repeated rows are copies like any other; rows with a null doc_id are treated as any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, among, block_count, cuts, mixed, packed, packed_blocks, sliding, stored, target_count, texts_of, unpacked, window_hashes, word_hashes

WINDOW = 35
LEAST = 8


def lengths(window: int) -> list[int]:
    """The window's length and its halves, rounded up, down to LEAST words; ascending."""
    out = [window]
    while (half := -(-out[-1] // 2)) > LEAST:
        out.append(half)
    return out[::-1]


def anchors(h: np.ndarray, window: int, length: int, alive: np.ndarray | None) -> np.ndarray:
    """
    Hashes of the anchor positions of the windows that are alive, mixed anew: anchors are least hashes, so equal ranges of
    the hash space would be far from equally full.
    """
    each = window_hashes(h, length, length)
    span = window - length + 1
    least = sliding(each, span)
    most = least if alive is None else np.where(alive, least, U64(0))
    edge = np.zeros(span - 1, U64)
    best = sliding(np.concatenate([edge, most, edge]), span, np.maximum)
    return mixed(each[(best == each) & (each > 0)])


def survivors(h: np.ndarray, window: int, length: int, repeated: np.ndarray) -> np.ndarray:
    """For each window of a document whether its anchor at this length repeats."""
    return among(mixed(sliding(window_hashes(h, length, length), window - length + 1)), repeated)


def _repeated(right: pa.Table | None) -> np.ndarray:
    if right is None or not right.num_rows:
        return np.empty(0, U64)
    return np.sort(np.concatenate([np.frombuffer(x.as_buffer(), U64) for x in right.column("hashes")]))


def _requests(window: int, length: int, before: int | None, targets: int, column: str):
    def ask(left: pa.Table, right: pa.Table | None = None) -> pa.Table:
        known, found = _repeated(right), []
        for text in texts_of(left.column("payload"), column) if left.num_rows and (before is None or len(known)) else ():
            h = word_hashes(text)
            if len(h) < window:
                continue
            alive = None if before is None else survivors(h, window, before, known)
            if alive is None or alive.any():
                found.append(anchors(h, window, length, alive))
        values, counts = np.unique(np.concatenate(found) if found else np.empty(0, U64), return_counts=True)
        at = cuts(values, targets)
        rows = [(t, values[a:b], counts[a:b] > 1) for t, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
        block = left.column("block")[0].as_py() if left.num_rows else 0
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int32()), pa.array([packed(r[1]) for r in rows], pa.binary()), pa.array([packed(r[2]) for r in rows], pa.binary())], names=["target", "block", "hashes", "many"])

    return ask


def _alone(ask):
    return lambda left: ask(left)


def _answers(asked: pa.Table) -> pa.Table:
    values = [np.frombuffer(x.as_buffer(), U64) for x in asked.column("hashes")]
    weight = np.concatenate([np.frombuffer(x.as_buffer(), bool) for x in asked.column("many")]).astype(np.int8) + 1
    _, inverse = np.unique(np.concatenate(values), return_inverse=True)
    again = (np.bincount(inverse, weight) > 1)[inverse]
    ends = np.cumsum([len(v) for v in values])[:-1]
    kept = [v[m] for v, m in zip(values, np.split(again, ends), strict=True)]
    rows = [(b.as_py(), packed(k)) for b, k in zip(asked.column("block"), kept, strict=True) if len(k)]
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "hashes"])


def cut_repeats(docs: DataFrame, window: int = WINDOW, edit: bool = False) -> DataFrame:
    """
    Removes each word that a repeated window covers. Returns doc_id, n_words, n_removed, kept (the words left, joined by
    one space); or, with `edit`, the columns of `docs` with text and n_chars replaced where words went (other texts stay
    as they were; a document of which nothing is left stays with an empty text).
    """
    full = docs if edit else docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    names = full.columns
    column = f"c{names.index('text')}"
    n_blocks = block_count(full)
    targets = target_count(n_blocks)
    blocks = packed_blocks(full, n_blocks)
    before, found = None, None
    for length in lengths(window):
        ask = _requests(window, length, before, targets, column)
        schema = "target int, block int, hashes binary, many binary"
        if found is None:
            asked = blocks.groupBy("block").applyInArrow(_alone(ask), schema)
        else:
            asked = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(ask, schema)
        found = stored(asked.repartition(targets, "target").groupBy("target").applyInArrow(_answers, "block int, hashes binary"), f"repeats-{length}")
        before = length
        if found.isEmpty():
            break

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        known, last = _repeated(right), before == window
        n_words, n_removed, kept = [], [], []
        rows = unpacked(left.column("payload")) if left.num_rows else None
        for text in rows.column(column) if rows else ():
            words = (text.as_py() or "").encode().split()
            covered = np.zeros(len(words), bool)
            if last and len(known) and len(words) >= window:
                hit = np.flatnonzero(survivors(word_hashes(text.as_py()), window, window, known))
                change = np.zeros(len(words) + 1, np.int32)
                np.add.at(change, hit, 1)
                np.add.at(change, hit + window, -1)
                covered = np.cumsum(change)[:-1] > 0
            gone = int(covered.sum())
            n_words.append(len(words))
            n_removed.append(gone)
            kept.append(b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c] if gone else words).decode() if gone or not edit else text.as_py())
        if not edit:
            ids = rows.column(0) if rows else pa.array([], pa.int64())
            return pa.table([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.large_string()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])
        for name, values in (("text", kept), ("n_chars", [len(k) if g else None for k, g in zip(kept, n_removed, strict=True)])):
            if rows and name in names:
                i = names.index(name)
                old = rows.column(i)
                new = pa.array(values, old.type if name == "n_chars" else pa.string())
                rows = rows.set_column(i, f"c{i}", new if name == "text" else pa.compute.coalesce(new, old.combine_chunks()))
        return rows if rows else schema_of.empty_table()

    if not edit:
        schema_of, schema = None, "doc_id long, n_words long, n_removed long, kept string"
        return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(finish, schema)
    plain = full.toDF(*[f"c{i}" for i in range(len(names))])
    from pyspark.sql.pandas.types import to_arrow_schema

    schema_of = to_arrow_schema(plain.schema)
    out = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(finish, plain.schema)
    return out.toDF(*names)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    out = cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), WINDOW)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+34], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
again AS (SELECT hash(s) AS h FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, i FROM win WHERE hash(s) IN (SELECT h FROM again)),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, range(0, 35) t(k)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
