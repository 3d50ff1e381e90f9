"""
BPE encoding with a priority queue of merge ranks over a doubly linked list of symbols, and decoding by joining
vocabulary strings.

The file names the steps: added tokens are cut out of the raw text; the rest is normalised (NFC, lower case), split into
words by the file's pattern, turned into byte symbols with the end mark on the last, and merged. White space is dropped,
so replacing runs of it changes nothing. Letters that Unicode added after the library's tables were made may be split
otherwise. The ids of words of up to CACHED_LENGTH characters are kept in a cache of bounded size. Each text is encoded
whole.

Null and empty texts give no ids and an empty decoded text. Rows are independent, so ties, repeated rows, empty tables
and further columns need no care.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, release_memory, spread

#: Words in each of two caches, and the most characters of a word that is kept there.
CACHE, CACHED_LENGTH = 300_000, 32


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else the next free one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class WordBpe:
    """The tokenizer in a JSON file of the tokenizers library's format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.symbols = byte_symbols()
        # a merge's rank and result, by the ids of its two sides
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.strings = [""] * (max([*self.vocab.values(), *added.values()]) + 1)
        for s, i in [*self.vocab.items(), *added.items()]:
            self.strings[i] = s
        self.first = [self.vocab.get(s) for s in self.symbols]
        self.last = [self.vocab.get(s + self.end) for s in self.symbols]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, word: bytes) -> list[int]:
        """Merges the pair of least rank, leftmost first, until none is left. Entries that a merge made stale are skipped."""
        ids = [*map(self.first.__getitem__, word[:-1]), self.last[word[-1]]]
        ids = [i for i in ids if i is not None]
        merges, n = self.merges, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(found[0], i, found[1], pair) for i, pair in enumerate(zip(ids, ids[1:])) if (found := merges.get(pair))]  # noqa: B905
        heapq.heapify(queue)
        while queue:
            _, i, new, pair = heapq.heappop(queue)
            j = after[i]
            if j < 0 or ids[i] != pair[0] or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if found := merges.get((new, ids[k])):
                    heapq.heappush(queue, (found[0], i, found[1], (new, ids[k])))
            h = before[i]
            if h >= 0 and (found := merges.get((ids[h], new))):
                heapq.heappush(queue, (found[0], h, found[1], (ids[h], new)))
        return [i for i in ids if i >= 0]

    def of_word(self, word: str) -> bytes:
        out = self.young.get(word)
        if out is None:
            out = self.old.get(word)
            if out is None:
                out = np.array(self.merged(word.encode()), np.int32).tobytes()
            if len(word) > CACHED_LENGTH:
                return out
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[word] = out
        return out

    def plain(self, text: str) -> bytes:
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        low = text.lower() if "Σ" not in text else "".join(map(str.lower, text))  # each character by itself
        return b"".join(map(self.of_word, self.words.findall(low)))

    def encode(self, text: str | None) -> bytes:
        """Ids as 32-bit integers."""
        if not text:
            return b""
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self.plain(text[at : m.start()]), np.int32(self.added[m[0]]).tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: vocabulary strings joined by one space."""
        return " ".join(map(self.strings.__getitem__, ids))


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One tokenizer for each file and worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string. `path` must be readable on each executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                each = [np.frombuffer(bpe.encode(x.as_py()), np.int32) for x in part.column(1)]
                offsets = np.cumsum([0, *map(len, each)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(each)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array([bpe.decode(x.tolist()) for x in each], pa.string())], names=["doc_id", "ids", "decoded"])
        release_memory()

    return spread(id_and_text(docs)).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def word_bpe_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_bpe_path()))
