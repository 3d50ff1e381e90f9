"""Runs of common tokens as candidates, sketches before whole sets are sent, and times."""

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest

from newsloom.operators import similarity

SCHEMA = "doc_id long, text string"


@pytest.fixture
def confirmed_pairs(monkeypatch):
    """How many pairs were confirmed on whole sets."""
    counts, own = [], similarity.confirmed
    monkeypatch.setattr(similarity, "confirmed", lambda pairs, sets, hundredths: (counts.append(pairs.count()), own(pairs, sets, hundredths))[1])
    return counts


def _alike(x, y):
    return len(x & y) * 100 >= len(x | y) * 70


def test_sets_of_the_same_words_that_are_not_alike_are_not_sent(spark, confirmed_pairs):
    dice = random.Random(3)
    rows = [(k, " ".join(dice.sample([f"common{i}" for i in range(70)], 30))) for k in range(120)]
    rows += [(500 + k, " ".join([f"copied{i}" for i in range(40)] + [f"changed{k}"])) for k in range(20)]
    got = {r.doc_id: r.n_links for r in similarity.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    sets = {i: set(t.split()) for i, t in rows}
    assert got == {i: sum(_alike(s, sets[j]) for j in sets if j != i) for i, s in sets.items()}
    assert 190 <= confirmed_pairs[0] < 300  # 20 * 19 / 2 are alike; all of 120 * 119 / 2 share words


def test_times_part_sets(spark, confirmed_pairs):
    rows = [(k, datetime(2024, 1, 1) + timedelta(days=5 * k), " ".join([f"copied{i}" for i in range(40)] + [f"changed{k}"])) for k in range(30)]
    rows += [(99, None, rows[0][2] + " without-time")]
    got = {r.doc_id for r in similarity.recent_duplicates(spark.createDataFrame(rows, "doc_id long, ts timestamp, text string")).collect() if r.is_duplicate}
    assert got == set(range(1, 30)) and confirmed_pairs == [29]


@pytest.mark.parametrize("hundredths", [50, 70, 71, 83, 90, 100])
def test_no_pair_is_missed(spark, hundredths):
    dice, sets = random.Random(hundredths), {}
    for g in range(40):
        base = [1000 * g + i for i in range(g + 1)]
        for k in range(8):
            own = [dice.randrange(10**6, 10**9) for _ in range(dice.randrange(g // 4 + 2))]
            sets[10 * g + k] = sorted({*dice.sample(base, len(base) - dice.randrange(g // 5 + 1)), *own})
    by_tokens = {tuple(s): i for i, s in sets.items() if s}
    rows = spark.createDataFrame([(i, list(s)) for s, i in by_tokens.items()], "id long, tokens array<long>")
    sets = {i: set(s) for s, i in by_tokens.items()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 100 >= len(sets[a] | sets[b]) * hundredths}
    got = sorted(map(tuple, similarity.similar_classes(rows, hundredths).collect()))
    assert got == sorted(want) and (want or hundredths == 100)


def test_sketches_never_part_what_is_alike():
    dice = np.random.default_rng(1)
    sets = [np.unique(dice.integers(0, 4 * n, n)) for n in (1, 5, 31, 32, 33, 64, 90, 127, 128, 129, 300) for _ in range(12)]
    sets += [np.unique(np.append(s[dice.random(len(s)) > 0.12], dice.integers(10**6, 10**7, len(s) // 9))) for s in sets]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets)), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "tokens"])
    table = pa.Table.from_batches(similarity._sketches([batch.slice(0, 50), batch.slice(50)]))
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))]
    found = similarity._likely(70)(pa.table({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}), table)
    got = set(zip(found.column("a").to_pylist(), found.column("b").to_pylist(), strict=True))
    want = {(a, b) for a, b in pairs if len(sets[a]) and _alike(set(sets[a].tolist()), set(sets[b].tolist()))}
    assert want <= got and len(want) > 100


def test_shared_tokens_by_products_and_by_search():
    dice = np.random.default_rng(2)
    sets = [np.unique(dice.integers(0, 9000, n)) for n in dice.integers(1, 400, 60)] + [np.arange(0, 9000)]
    size = np.array([len(s) for s in sets])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(30), np.arange(30, 61), indexing="ij"))
    (rows, x), (columns, y) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
    args = np.concatenate(sets), np.cumsum(size) - size, size
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)]
    assert similarity._by_product(*args, rows, columns, x, y).tolist() == similarity._by_search(*args, a, b).tolist() == want
