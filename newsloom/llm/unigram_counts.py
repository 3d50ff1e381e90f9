"""
Token counts under a unigram vocabulary, without making the tokens: an Aho-Corasick automaton enumerates the vocabulary
matches that end at each character, and dynamic programming carries the best score and its number of pieces.

Words are runs of characters that are not white space, each with the word mark in front; no piece spans two words. Ties
follow the tokenizers library's unigram model: of paths to one place with equal scores, the one whose last piece starts
first stays. A character that no single-character piece covers may stand as unknown at the least piece's score minus 10;
a run of unknown characters counts its UTF-8 bytes (byte fallback), or as one piece without fallback.

The vocabulary's size is fixed by its file. Null and empty texts have no pieces. Rows are independent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, spread

MARK = "▁"
#: The characters with Unicode's White_Space property, as the tokenizers library splits at them.
WORDS = re.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
UNKNOWN_PENALTY = 10.0
#: Words in each of two caches, and the most characters of a word that is kept there.
CACHE, CACHED_LENGTH = 300_000, 32


class UnigramCounter:
    """Counts pieces of words; `pieces` are (string, score)."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.young: dict[str, tuple[int, float]] = {}
        self.old: dict[str, tuple[int, float]] = {}

    def of_word(self, word: str) -> tuple[int, float]:
        out = self.young.get(word)
        if out is None:
            out = self.old.get(word) or self.counted(MARK + word)
            if len(word) > CACHED_LENGTH:
                return out
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[word] = out
        return out

    def counted(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best path through `word`."""
        n = len(word)
        score, pieces, open_ = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        at, single = 0, self.single

        def unknown_to(end: int) -> None:
            # the candidate that starts last, so it comes after all matches that end here
            if word[end - 1] not in single and (score[end] is None or score[end - 1] + self.unknown > score[end]):
                score[end] = score[end - 1] + self.unknown
                run = open_[end - 1]
                pieces[end] = pieces[end - 1] + (len(word[end - 1].encode()) if self.byte_fallback else not run)
                open_[end] = True

        for last, (length, value) in self.automaton.iter(word):  # by end; of one end, the longest first
            while at < last:
                at += 1
                unknown_to(at)
            end, start = last + 1, last + 1 - length
            if score[start] is not None and (score[end] is None or score[start] + value > score[end]):
                score[end], pieces[end], open_[end] = score[start] + value, pieces[start] + 1, False
        while at < n:
            at += 1
            unknown_to(at)
        return pieces[n], score[n]


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece model with their scores."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]


_LOADED: dict[str, UnigramCounter] = {}


def loaded(path: str) -> UnigramCounter:
    if path not in _LOADED:
        _LOADED[path] = UnigramCounter(vocabulary(path))
    return _LOADED[path]


def piece_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, best_score. `path` must be readable on each executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path)
        for batch in batches:
            words, tokens, scores = [], [], []
            for x in batch.column(1):
                found = list(map(counter.of_word, WORDS.findall(x.as_py() or "")))
                words.append(len(found))
                both = np.array(found, np.float64).reshape(-1, 2).sum(0)
                tokens.append(int(both[0]))
                scores.append(float(both[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_words", "n_tokens", "best_score"])

    return spread(id_and_text(docs)).mapInArrow(run, "doc_id long, n_words long, n_tokens long, best_score double")


def piece_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op9_unigram_counts(spark, sf_dir: str) -> DataFrame:
    return piece_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), piece_path())
