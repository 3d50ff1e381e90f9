"""Near-dedup against all pairs, and the pipeline's stages against plain versions."""

import random

import pytest

import corpus_pipeline
from newsloom.llm import minhash_dedup as M

from .test_text_operators import ODD, SF, cut, docs_of


def components(rows, width, like=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= like * (len(sets[x]) + len(sets[y]) - both) and top(x) != top(y):
                    up[max(top(x), top(y))] = min(top(x), top(y))
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def near_copies(seed):
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(4000)}"
    rows = []
    for group in range(12):
        base = [word() for _ in range(draw.choice([3, 30, 120]))]
        for _ in range(draw.choice([1, 2, 25])):
            share = draw.choice([0, 0.02, 0.05, 0.1])
            rows.append(" ".join(word() if draw.random() < share else w for w in base))
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("width,seed", [(2, 1), (5, 2)])
def test_near_copies(spark, width, seed, monkeypatch):
    monkeypatch.setattr(M, "TILE", 8)
    rows = [*near_copies(seed), (900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "x " * 20_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(docs_of(spark, rows), width).collect()}
    assert got == components(rows, width)


def test_odd_rows(spark):
    got = M.near_duplicates(docs_of(spark, ODD)).collect()
    assert len(got) == len(ODD) and {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 6, None: None, 7: 7}
    assert M.near_duplicates(docs_of(spark, [])).collect() == []
    kept = M.without_near_duplicates(docs_of(spark, ODD))
    assert kept.columns == docs_of(spark, []).columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 6, 7, None}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    near = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    want = components(list(rows.items()), 5)
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == {i for i, (_, _, kept) in want.items() if kept}
    text = corpus_pipeline.substring_stage(spark, docs, SF)
    plain = dict(zip(rows, cut(rows.values(), 35), strict=True))
    assert {r.doc_id: r.text for r in text.collect()} == {i: (plain[i][2] if plain[i][1] else t) for i, t in rows.items()}
    quality = corpus_pipeline.quality_stage(spark, docs, SF)
    assert quality.columns == docs.columns and 0 < quality.count() < len(rows)
    bench = {tuple(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    clean = corpus_pipeline.decontamination_stage(spark, docs, SF)
    assert clean.columns == docs.columns and 0 < clean.count() < len(rows) and bench


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() < 200
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
