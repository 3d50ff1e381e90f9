"""Stages of the pipeline, and the whole of it, against plain versions."""

import hashlib
import re

import pytest

import corpus_pipeline
from newsloom.llm import bpe
from newsloom.llm.quality_fm import KEEP, quality

from .test_dedup_pipeline import components
from .test_text_operators import SF, cut


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def is_clean(text, windows):
    w = words_of(text)
    return not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))


@pytest.fixture(scope="module")
def windows(spark):
    items = [words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    return {tuple(w[i : i + 10]) for w in items if w for i in range(max(len(w) - 9, 1))}


@pytest.fixture(scope="module")
def good(spark):
    """Documents whose fitted score reaches KEEP."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = docs.select("doc_id", "text", quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).alias("s")).collect()
    return {r.doc_id: r.text for r in scored if r.s >= KEEP}


def test_quality_and_decontamination(spark, windows, good):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, SF).collect()} == set(good)
    want = {r.doc_id for r in docs.collect() if is_clean(r.text, windows)}
    assert {r.doc_id for r in corpus_pipeline.decontamination_stage(spark, docs, SF).collect()} == want


def test_run_like_the_plain_stages(spark, windows, good):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.word_bpe_path())
    t.no_truncation()
    t.no_padding()
    rows = [(i, good[i]) for i, (_, _, kept) in components(list(good.items()), 5).items() if kept]
    cuts = cut([x for _, x in rows], 35)
    rows = [(i, c[2] if c[1] else x) for (i, x), c in zip(rows, cuts, strict=True)]
    want = {}
    for i, x in rows:
        if is_clean(x, windows):
            ids = t.encode(x or "", add_special_tokens=False).ids
            want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()} == want
