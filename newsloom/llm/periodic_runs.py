"""
Periodic runs: stretches of a text in which a phrase is said again and again. A run is a stretch of consecutive words with
smallest period q (words q apart are identical) that has `times` periods at least, and `least` words, and that no
neighbouring word extends.

Blocks are matched scale by scale. For periods from b to 2b - 1, b a power of two, the text's aligned blocks of b words are
keys of an Aho-Corasick automaton over word numbers, which is run over the whole text. A block that occurs again b to
2b - 1 words later is a seed: its distance is compared word by word in both directions as far as it holds. (Keys have at most
KEY numbers; those of longer blocks are exact numbers of their parts.) No run is
missed: the first aligned block in a run of period q, 2b > q >= b, ends within its first 2b - 1 words, so with times >= 3 it
occurs again q words later inside the run. Nor is work done twice: blocks are keys only if each of their words is said
again within 2b - 1 words, and seeds inside a run whose period divides their distance are that run again. Such runs have
the same borders, so of stretches with equal borders the smallest distance is the period.

Words are runs of characters other than the six ASCII spaces; a null text has none. A text is scanned whole, in one
task; memory is a few integers a word. Rows are independent: repeated rows and null ids are given results of their own, an
empty table has none, and no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, release_memory, spread

#: Periods that a run has at least, and words.
TIMES, LEAST = 4, 6
#: Numbers in a key of the automaton at most; a power of two.
KEY = 8
RUN = "array<struct<start:long,length:long,period:long>>"


def word_numbers(words: list) -> np.ndarray:
    """Equal words have equal numbers."""
    seen: dict = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _same(x: np.ndarray, at: int, by: int) -> int:
    """How many words from `at` on equal those `by` words later; ever longer slices are compared."""
    n, done, step = len(x) - by, at, 32
    while done < n:
        differ = np.flatnonzero(x[done : min(done + step, n)] != x[done + by : min(done + step, n) + by])
        if len(differ):
            return done + int(differ[0]) - at
        done, step = min(done + step, n), step * 2
    return n - at


def _same_before(x: np.ndarray, at: int, by: int) -> int:
    """The same backwards, for the words before `at`."""
    done, step = at, 32
    while done > 0:
        a = max(done - step, 0)
        differ = np.flatnonzero(x[a:done] != x[a + by : done + by])
        if len(differ):
            return at - (a + int(differ[-1]) + 1)
        done, step = a, step * 2
    return at


class _Names:
    """Numbers for stretches of words: at(2^j)[i] is the number of the 2^j words from i on, equal if and only if they are."""

    def __init__(self, x: np.ndarray):
        self.width, self.names = 1, x

    def at(self, width: int) -> np.ndarray:
        """Widths must ascend."""
        while self.width < width:
            two = self.names[: -self.width] * (len(self.names) + 1) + self.names[self.width :]
            self.names, self.width = np.unique(two, return_inverse=True)[1], 2 * self.width
        return self.names


def _matches(names: _Names, blocks: np.ndarray, b: int) -> dict[int, np.ndarray]:
    """
    Of each block (by its first word's place) where in the text its words occur, in order. A key has at most KEY numbers,
    as the automaton looks at all suffixes of what it has read: of longer blocks they stand for equally long parts, and the
    text is given as its sequences of such parts from each place on, with a number that no key has in between.
    """
    step = max(b // KEY, 1)
    x = names.at(step)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    first: dict[tuple, int] = {}
    own = {}
    for s in blocks.tolist():
        key = tuple(x[s : s + b : step].tolist())
        if key not in first:
            first[key] = s
            automaton.add_word(key, s)
        own[s] = first[key]
    automaton.make_automaton()
    rows = -(-len(x) // step)
    text = np.full((step, rows + 1), len(x) + 1, np.int64)
    padded = np.full(rows * step, len(x) + 1, np.int64)
    padded[: len(x)] = x
    text[:, :rows] = padded.reshape(rows, step).T
    found: dict[int, list[int]] = {s: [] for s in first.values()}
    for last, s in automaton.iter(tuple(text.ravel().tolist())):
        found[s].append(last)
    length = b // step
    places = {}
    for s, at in found.items():
        place, row = np.divmod(np.array(at, np.int64), rows + 1)
        places[s] = np.sort((row - length + 1) * step + place)
    return {s: places[k] for s, k in own.items()}


def runs_of(x: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of word numbers, by start and period."""
    n = len(x)
    if times < 3:
        raise ValueError("a run has three periods at least")
    if n < least:
        return []
    order = np.argsort(x, kind="stable")
    again = np.full(n, n, np.int64)  # how far the word's next occurrence is
    same = x[order[1:]] == x[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    known: dict[tuple[int, int], int] = {}
    names, b = _Names(x), 1
    while b <= n // times:
        count = n // b
        blocks = np.flatnonzero(again[: count * b].reshape(count, b).max(1) < 2 * b) * b
        if len(blocks):
            _seeded(x, names, blocks, b, known, times, least)
        b *= 2
    return sorted((s, e - s, q) for (s, e), q in known.items())


def _seeded(x: np.ndarray, names: _Names, blocks: np.ndarray, b: int, known: dict[tuple[int, int], int], times: int, least: int) -> None:
    """Adds the runs with periods from b to 2b - 1 to `known`: (start, end) to period."""
    most = len(x) // times
    # of the runs that start before a place, the one that ends last; all have shorter periods
    starts, far, period = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    if known:
        borders = np.array(sorted(known), np.int64)
        starts, far = borders[:, 0], np.maximum.accumulate(borders[:, 1])
        last = np.maximum.accumulate(np.where(borders[:, 1] == far, np.arange(len(far)), 0))
        period = np.array([known[s, e] for s, e in borders[last].tolist()], np.int64)
        at = np.searchsorted(starts, blocks, "right") - 1
        # a block and all up to 3b behind it in one run say nothing new
        blocks = blocks[(at < 0) | (far[at] < blocks + 3 * b)]
    if not len(blocks):
        return
    places = _matches(names, blocks, b)
    seen: dict[int, tuple[int, int]] = {}  # of each distance the stretch that was compared last
    for s in blocks.tolist():
        at = places[s]
        k = int(np.searchsorted(starts, s, "right")) - 1
        for t in at[np.searchsorted(at, s + b) : np.searchsorted(at, min(s + 2 * b, s + most + 1))].tolist():
            d = t - s
            a, e = seen.get(d, (s, 0))
            if (a <= s and t + b <= e) or (k >= 0 and t + b <= far[k] and d % period[k] == 0):
                continue
            start, end = seen[d] = s - _same_before(x, s, d), s + _same(x, s, d) + d
            if end - start >= max(least, times * d):
                known[start, end] = min(d, known.get((start, end), d))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when of each run only the first period does."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return np.cumsum(gone[:n]) == 0


def periodic_runs(docs: DataFrame, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start and period), collapsed: the text without what runs repeat."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, found, collapsed = [], [], []
            for x in b.column(1):
                words = x.as_py().encode().split() if x.is_valid else []
                runs = runs_of(word_numbers(words), times, least)
                n_words.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                stay = kept_words(len(words), runs) if runs else None
                collapsed.append(b" ".join(words if stay is None else [w for w, k in zip(words, stay.tolist(), strict=True) if k]))
            kind = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(found, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
        release_memory()

    return spread(id_and_text(docs)).mapInArrow(scan, f"doc_id long, n_words long, runs {RUN}, collapsed string")


def looped(text: Column, h: Column) -> Column:
    """
    The text with a planted loop where 10 divides h: with g = h // 10 and n words, each word i >= a = g % n becomes word
    a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8).
    """
    words, g = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)), F.floor(h / 10)
    facts = F.struct(words.alias("w"), F.size(words).cast("long").alias("n"))

    def edited(x: Column) -> Column:
        a = g % x["n"]
        p = 1 + F.floor((x["n"] - a) / (3 + g % 8))
        at = F.sequence(F.lit(0).cast("long"), x["n"] - 1)
        return F.array_join(F.transform(at, lambda i: F.element_at(x["w"], (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int"))), " ")

    made = F.element_at(F.transform(F.array(facts), lambda x: F.when(x["n"] > 0, edited(x))), 1)
    return F.when(h % 10 == 0, F.coalesce(made, text)).otherwise(text)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    out = periodic_runs(docs.select("doc_id", looped(F.col("text"), h).alias("text")))
    # greatest length, then smallest start, then smallest period
    first = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("r"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("r.start"), F.col("r.length"), -F.col("r.period")
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
