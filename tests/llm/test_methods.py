"""The methods told plainly: votes and radius, machine and gradient, kernels, trees, byte runs; and odd rows of each operator."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.llm import chat_format, decontaminate, language_id, minhash_dedup, quality_fm, simhash, unigram_counts

from .test_text_operators import ODD, SF, docs_of


def plain_fingerprint(text):
    votes = [0.0] * 128
    for w, c in Counter((text or "").encode().lower().split()).items():
        h = xxhash.xxh3_128_intdigest(w)
        for i in range(128):
            votes[i] += (1 if h >> (127 - i) & 1 else -1) * (1 + math.log(c)) * min(len(w), 6) ** 2
    return sum(1 << (127 - i) for i, v in enumerate(votes) if v > 0).to_bytes(16)


@pytest.mark.parametrize("text", ["a", "The the THE cat sat on the mat", "É ß 漢字 don't", "", None, "one two three four five six seven eight nine ten"])
def test_votes(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("tile,radius,spare", [(8, 3, 1), (1024, 6, 2), (3, 2, 2)])
def test_radius(spark, monkeypatch, tile, radius, spare):
    """All fingerprints within the radius are found and counted once, also across tiles."""
    monkeypatch.setattr(simhash, "TILE", tile)
    draw = random.Random(tile)
    base = [draw.getrandbits(128) for _ in range(5)]
    marks = [m ^ sum(1 << draw.randrange(128) for _ in range(draw.randrange(4))) & (2**128 - 1) for m in base for _ in range(20)]
    marks += marks[:20] + [0] * 5
    got = {bytes(r.fingerprint): (r.n, r.near) for r in simhash.within_radius(spark.createDataFrame([(m.to_bytes(16),) for m in marks], "fingerprint binary"), radius, spare).collect()}
    each = {m: (marks.count(m), sum(0 < (m ^ o).bit_count() <= radius for o in marks)) for m in set(marks)}
    assert got == {m.to_bytes(16): v for m, v in each.items() if v[0] > 1 or v[1]}


def test_near_counts_of_the_query(spark):
    rows = simhash.op1_simhash(spark, SF).collect()
    marks = [int(r.fingerprint, 16) for r in rows]
    assert [r.n_near for r in rows] == [sum((m ^ o).bit_count() <= simhash.RADIUS for o in marks) - 1 for m in marks] and max(r.n_near for r in rows) > 0


def machine(seed, n=7):
    draw = np.random.default_rng(seed)
    w = quality_fm.Weights(draw.normal(0, 0.3, (quality_fm.PLACES + 1, 1 + quality_fm.FACTORS)))
    at = draw.choice(quality_fm.PLACES, n, replace=False)
    return w, at, draw.normal(0, 1, n)


def pairwise(w, at, x):
    out = w.all[-1, 0] + sum(w.all[p, 0] * v for p, v in zip(at, x))
    return out + sum(float(w.all[at[i], 1:] @ w.all[at[j], 1:]) * x[i] * x[j] for i in range(len(at)) for j in range(i))


def test_sum_of_squares_identity():
    w, at, x = machine(1)
    assert w.raw(at, x, np.array([0]))[0][0] == pytest.approx(pairwise(w, at, x))
    both = w.raw(np.concatenate([at, at[:3]]), np.concatenate([x, x[:3]]), np.array([0, len(at)]))[0]
    assert both == pytest.approx([pairwise(w, at, x), pairwise(w, at[:3], x[:3])])


def test_learning_follows_the_gradient(monkeypatch):
    """With one row and one batch, weights move against the sign of the loss's finite differences."""
    monkeypatch.setattr(quality_fm, "STEPS", 0)
    monkeypatch.setattr(quality_fm, "DECAY", 0.0)
    w, at, x = machine(2)
    before, y = w.all.copy(), 1
    loss = lambda: math.log1p(math.exp(-pairwise(w, at, x)))
    slopes = np.zeros((len(at), 1 + quality_fm.FACTORS))
    for i, p in enumerate(at):
        for k in range(1 + quality_fm.FACTORS):
            w.all[p, k] += 1e-5
            up = loss()
            w.all[p, k] -= 2e-5
            slopes[i, k] = (up - loss()) / 2e-5
            w.all[p, k] = before[p, k]
    learnt = quality_fm.Weights(before.astype(np.float64).copy())
    learnt.learn([(at, x)], np.array([y]), 0)
    step = 8 * slopes
    assert learnt.all[at] - before[at] == pytest.approx(-quality_fm.RATE * step / np.sqrt(1e-2 + step**2), abs=1e-4)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, None if t is None else len(t), "z", 1) for i, t in ODD], "doc_id long, text string, n_chars long, meta string, y int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (4, None), (5, 0), (6, 1), (None, 1), (7, 0)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        got = docs.select("doc_id", quality_fm.quality(docs, known).alias("s")).collect()
        assert len(got) == len(ODD) and all(0 <= r.s <= 1 for r in got) and len({r.s for r in got if r.doc_id == 5}) == 1
    assert {r.s for r in docs.select(quality_fm.quality(docs, labels.limit(0)).alias("s")).collect()} == {0.5}
    assert docs.limit(0).select(quality_fm.quality(docs, labels).alias("s")).collect() == []


def dense(text):
    row = np.zeros(len(language_id.WEIGHTS))
    row[language_id.presence(text)] = 1
    row *= np.sqrt(language_id.WEIGHTS)
    return row / np.sqrt((row**2).sum())


def test_kernel_landmarks_and_ridge(spark):
    draw = random.Random(5)
    words = {"en": "the of and to in is it".split(), "de": "der die und das ist ein zu".split(), "fr": "le la les des et est un".split()}
    rows = [(i, " ".join(draw.choice(words[lang]) + draw.choice(["", "s", "en"]) for _ in range(12)), lang) for i in range(1, 91) for lang in [draw.choice(sorted(words))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chosen = language_id.chosen_rows(docs, 60)
    model = language_id.fit(docs, sample=60, landmarks=20)
    text = {i: t for i, t, _ in rows}
    assert len(chosen) == 60 and len({r.doc_id for r in chosen}) == 60
    marks = np.stack([dense(text[i]) for i in sorted(r.doc_id for r in chosen[:20])])
    values, basis = np.linalg.eigh(marks @ marks.T)
    phi = lambda ts: np.stack([dense(t) for t in ts]) @ marks.T @ (basis / np.sqrt(values))
    x, y = phi([text[r.doc_id] for r in chosen]), np.array([[1 if r.lang == lang else -1 for lang in model.langs] for r in chosen])
    solved = np.linalg.solve(x.T @ x + language_id.RIDGE * 60 * np.eye(20), x.T @ y)
    raw = phi([t for _, t, _ in rows]) @ solved
    assert model.predict([t for _, t, _ in rows])[0] == [model.langs[k] for k in raw.argmax(1)]
    buffer = language_id.Presence(3)
    few = [t for _, t, _ in rows[:3]]
    for _ in range(2):  # the buffer is clean again after use
        got = buffer.times([language_id.presence(t) for t in few], np.eye(len(language_id.WEIGHTS), 50, dtype=np.float32))
        want = np.stack([(dense(t) > 0)[:50] / np.sqrt(language_id.WEIGHTS[language_id.presence(t)].sum()) for t in few])
        assert got == pytest.approx(want)


def test_repeated_rows_are_learnt_once(spark):
    rows = [(1, "the same row again", "en")] * 1500 + [(i, f"der die das {i} und", "de") for i in range(2, 52)] + [(60, "½ ² Ⅷ", None), (61, "ª", "en"), (None, "the row", "xx")]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    said = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == len(rows) and (said[1], said[2], said[60]) == ("en", "de", "und") and said[61] != "und" and {r.held_out for r in got if r.doc_id is None} == {True}


def test_near_duplicates_without_names(spark):
    """Several texts of one id are rows of their own; null ids are linked but name nothing; of a component one row stays."""
    text = " ".join(f"w{i}" for i in range(60))
    near, other = text + " more", " ".join(f"v{i}" for i in range(60))
    rows = [(5, text), (5, other), (7, near), (None, text), (None, near), (9, other), (None, "lone words"), (None, "lone words"), (11, None), (11, None), (12, ""), (7, near)]
    docs = docs_of(spark, rows)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect())
    assert got == Counter({(5, 56, 5, True): 2, (7, 57, 5, False): 2, (None, 56, 5, False): 1, (None, 57, 5, False): 1, (9, 56, 5, False): 1, (None, 1, None, True): 2, (11, 0, 11, True): 2, (12, 0, 12, True): 1})
    kept = minhash_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter({(5, text): 1, (5, other): 1, (None, "lone words"): 1, (11, None): 2, (12, ""): 1})
    assert minhash_dedup.without_near_duplicates(docs.limit(0)).collect() == []


def test_decontamination_by_shuffles(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    more = docs.unionByName(docs.where("doc_id < 20")).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    bench = bench.withColumns({"word": F.lit("x"), "prefix": F.lit("y"), "n_words": F.lit(1)})
    found = [Counter(map(str, decontaminate.report(decontaminate.hits(more, bench, broadcast_bytes=most)).collect())) for most in (decontaminate.BROADCAST_BYTES, 0)]
    assert found[0] == found[1] and sum(found[0].values()) == more.count()
    long = docs_of(spark, [(1, "a " * 50_000 + "short item"), (2, None)])
    items = spark.createDataFrame([(1, "short item")], "item_id long, text string")
    for most in (decontaminate.BROADCAST_BYTES, 0):
        assert {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.report(decontaminate.hits(long, items, broadcast_bytes=most)).collect()} == {1: (50_002, 2), 2: (0, 0)}
        assert {r.n_hit for r in decontaminate.report(decontaminate.hits(long, items.limit(0), broadcast_bytes=most)).collect()} == {0}


def test_contaminated_texts_go_alone(spark):
    items = spark.createDataFrame([(1, "short item")], "item_id long, text string")
    rows = [(None, "a short item"), (None, "clean"), (1, "short item"), (1, "also clean"), (2, None), (None, None), (1, "also clean")]
    kept = decontaminate.without_contaminated(docs_of(spark, rows), items)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(None, "clean"), (1, "also clean"), (1, "also clean"), (2, None), (None, None)])


def trees(seed):
    draw, rows = random.Random(seed), []
    for tree in range(12):
        for node in range(draw.randrange(1, 14)):
            for _ in range(draw.choice([1, 1, 1, 2])):
                parent = draw.choice([None, draw.randrange(14), draw.randrange(14), draw.randrange(node + 1)])
                rows.append((f"t{tree}", node, parent, draw.choice([None, 0.0, 0.5, 1.0]), draw.choice(["user", "assistant", None]), draw.choice(["a<b", "\\", "", None, "x" * 3000])))
    return rows


def plain_paths(rows):
    links, out = {}, {}
    for tree, node, parent, score, *_ in rows:
        old = links.get((tree, node), (None, math.inf))
        parents = [p for p in (old[0], parent) if p is not None]
        links[tree, node] = (min(parents) if parents else None, min(old[1], score or 0.0))
    up = {k: (k[0], p) if p is not None and p != k[1] and (k[0], p) in links else None for k, (p, _) in links.items()}
    inner = {p for p in up.values() if p}
    for leaf in set(links) - inner:
        path, at = [], leaf
        while at and at not in path:
            path.append(at)
            at = up[at]
        if at is None:
            out[leaf[0], tuple(n for _, n in path[::-1])] = sum(links[n][1] for n in path)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_trees(spark, seed):
    rows = trees(seed)
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string")
    want = plain_paths(rows)
    found = chat_format.paths(nodes).cache()
    assert {(r.tree, tuple(r.path)): r.path_score for r in found.collect()} == want
    best = {}
    for (tree, path), score in want.items():
        best[tree] = min(best.get(tree, (math.inf, ())), (-score, path))
    picked = chat_format.best_paths(found)
    assert {r.tree: tuple(r.path) for r in picked.collect()} == {t: p for t, (_, p) in best.items()}
    turn = {}
    for tree, node, _, _, role, text in rows:
        turn[tree, node] = min(turn.get((tree, node), ("~", "")), (role or "", text or ""))
    for r in chat_format.read_back(chat_format.formatted(nodes, picked)).collect():
        said = [turn[r.tree, n] for n in best[r.tree][1]]
        assert [tuple(t) for t in r.turns] == said and r.loss_text == "".join(t for role, t in said if role == "assistant")


PIECES = [("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -3.5), ("aba", -6.0), ("\u2581", -1.0), ("\u2581a", -3.0), ("xb", -1.0)]


def viterbi(word, byte_fallback):
    """Best score, then the piece that starts first; runs of unknown characters count their bytes, or one."""
    known, single, unknown = dict(PIECES), {p for p, _ in PIECES if len(p) == 1}, min(s for _, s in PIECES) - 10
    best = [(0.0, [])]
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + known[word[s:end]], best[s][1] + [(s, end, True)]) for s in range(end) if word[s:end] in known and best[s]]
        if word[end - 1] not in single and best[end - 1]:
            options.append((best[end - 1][0] + unknown, best[end - 1][1] + [(end - 1, end, False)]))
        top = max(o[0] for o in options) if options else None
        best.append(next(o for o in options if o[0] == top) if options else None)
    score, path = best[-1]
    count = 0
    for i, (s, e, ok) in enumerate(path):
        count += 1 if ok else len(word[s:e].encode()) if byte_fallback else not (i and not path[i - 1][2])
    return count, score


@settings(max_examples=300, deadline=None)
@given(st.text("abxé漢", min_size=1, max_size=12), st.booleans())
def test_unigram_paths(word, byte_fallback):
    got = unigram_counts.UnigramCounter(PIECES, byte_fallback).of_word(word)
    want = viterbi(unigram_counts.MARK + word, byte_fallback)
    assert got[0] == want[0] and got[1] == pytest.approx(want[1])


def test_stages_take_odd_tables(spark):
    """Nulls, repeated rows, ids with several texts, clashing columns and empty tables go through every stage."""
    import corpus_pipeline

    passage = " ".join(f"p{i}" for i in range(60))
    rows = [*ODD, (None, None), (20, f"start {passage} end"), (21, f"other {passage} tail words"), (22, f"other {passage} tail words"), (20, "a second text of this id"), (20, "a second text of this id")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "b") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row int, block string")
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
        assert none.collect() == [], name
        got = Counter((r.doc_id, r.text) if "text" in out.columns else r.doc_id for r in out.collect())
        if name == "bpe":
            assert got == Counter(i for i, _ in rows)
        else:
            assert out.columns == docs.columns and sum(got.values()) <= len(rows)
        if name == "near dedup":
            assert got == Counter([(1, "a b c"), (2, None), (3, ""), (4, " \t\n"), *ODD[6:], (None, None), rows[10], rows[13]])
        if name == "decontamination":
            assert got == Counter(rows)
        if name == "substring dedup":
            assert got[(20, "start end")] == 1 and got[(21, "")] == got[(22, "")] == 1 and got[(20, "a second text of this id")] == 2
