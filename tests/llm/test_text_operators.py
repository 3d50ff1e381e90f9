"""The per-text operators against libraries and brute force, and what they do with odd rows."""

import hashlib
import math
import random
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.llm import bpe, chat_format, decontaminate, katz_lm, language_id, quality_fm, registry, simhash, substring_dedup, unigram_counts

from .katz_brute import katz

SF = "/root/testdata/sf0.001"
ODD = [(1, "a b c"), (2, None), (3, ""), (4, " \t\n"), (5, "a b c"), (5, "a b c"), (6, "É ÀΣ ß 漢字 <|endoftext|> don't 123 😀"), (None, "x y"), (7, "w " * 30_000)]


def docs_of(spark, rows):
    """With further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, block string, key long, id string")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registry.queries()[name](spark, SF)
    assert sorted(map(tuple, df.select(sorted(df.columns)).collect())) == sorted(map(tuple, con.execute(registry.oracle_sql()[name]).df()[sorted(df.columns)].itertuples(index=False)))


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.word_bpe_path())
    t.no_truncation()
    t.no_padding()
    return t, bpe.WordBpe(bpe.word_bpe_path())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(st.characters(exclude_categories=["Cn", "Cs"])), st.text("abcdefg 'sSΣß1.!éÉ\n<|endoftext|>")))
def test_bpe_like_the_library(word_bpe, text):
    theirs, ours = word_bpe
    want = theirs.encode(text, add_special_tokens=False).ids
    got = [int(i) for i in memoryview(ours.encode(text)).cast("i")] if text else []
    assert got == want
    assert ours.decode(got) == theirs.decode(want, skip_special_tokens=False)


def test_bpe_rows(spark, word_bpe):
    got = bpe.encode(docs_of(spark, ODD), bpe.word_bpe_path()).collect()
    assert len(got) == len(ODD)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(ODD, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        assert (r.doc_id, r.ids) == (i, word_bpe[0].encode(t or "", add_special_tokens=False).ids)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=14))
def test_unigram_ties_like_the_library(word):
    from tokenizers import Tokenizer, models

    pieces = [("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -3.5), ("aba", -6.0), ("▁", -1.0), ("▁a", -3.0), ("bb", -4.0)]
    theirs = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], 0, False))
    counter = unigram_counts.UnigramCounter([*pieces], byte_fallback=False)
    counter.unknown = min(0.0, *[s for _, s in pieces]) - 10
    assert counter.of_word(word)[0] == len(theirs.encode("▁" + word).ids)


def test_unigram_rows(spark):
    got = {r.doc_id: r for r in unigram_counts.piece_counts(docs_of(spark, ODD), unigram_counts.piece_path()).collect()}
    assert (got[2].n_tokens, got[3].n_tokens, got[4].n_tokens, got[7].n_words) == (0, 0, 0, 30_000)
    assert unigram_counts.piece_counts(docs_of(spark, []), unigram_counts.piece_path()).collect() == []


@pytest.mark.parametrize("order", [2, 3])
def test_katz(spark, order):
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice("the The a bb ccc d e f g h i j k".split()) + str(draw.randrange(4) * draw.randrange(9)) for _ in range(draw.randrange(40)))) for i in range(200)]
    rows += [(201, None), (202, ""), (203, "unheard of")]
    want, cond, p, unk = katz(rows, order=order)
    for salt in (None, 20):
        for r in katz_lm.katz_scores(docs_of(spark, rows), salt_over=salt, order=order).collect():
            assert tuple(r)[1:5] == want[r.doc_id][:4] and r.base_score == pytest.approx(want[r.doc_id][4]) and r.score == pytest.approx(want[r.doc_id][5])
    assert sum(p.values()) + unk == pytest.approx(1)
    for h in ("<start>", "the0", "nowhere"):
        h = ("<start>", h)[3 - order :]
        assert sum(map(cond(h), p)) + cond(h)("never") == pytest.approx(1)
    assert katz_lm.katz_scores(docs_of(spark, [])).collect() == []
    assert len(katz_lm.katz_scores(docs_of(spark, ODD)).collect()) == len(ODD)


def cut(texts, window):
    from collections import Counter

    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("window", [2, 9, 35])
def test_substring_dedup(spark, window):
    draw = random.Random(window)
    passage = " ".join(str(draw.randrange(50)) for _ in range(60))
    texts = [" ".join(str(draw.randrange(50)) for _ in range(draw.randrange(90))) + draw.choice(["", " " + passage, passage[40:]]) for _ in range(60)] + [None, "", passage + " " + passage]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.cut_repeats(docs_of(spark, list(enumerate(texts))), window).collect()}
    assert [got[i] for i in range(len(texts))] == cut(texts, window)
    assert substring_dedup.cut_repeats(docs_of(spark, []), window).collect() == []


def test_substring_dedup_keeps_columns(spark):
    docs = spark.createDataFrame([(i, t, None if t is None else len(t), "z") for i, t in ODD], "doc_id long, text string, n_chars long, c0 string")
    out = substring_dedup.cut_repeats(docs, edit=True)
    assert out.columns == docs.columns and {(r.doc_id, r.text) for r in out.collect() if r.doc_id != 7} == {(i, t) for i, t in ODD if i != 7}
    assert [(r.text, r.n_chars) for r in out.where("doc_id = 7").collect()] == [("", 0)]


def test_simhash(spark):
    rows = [r for r in ODD if r[0] is not None]
    got = sorted((*r[:3], bytes(r[3]).hex(), r[4]) for r in simhash.fingerprints_with_edits(docs_of(spark, rows), 3).select("doc_id", "n_chars", "edited_text", "fingerprint", "near_next").collect())
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    want = []
    for (i, t), (_, n) in zip(order, [*order[1:], order[0]], strict=True):
        t, n = t or "", n or ""
        want.append((i, len(t), t[: len(t) - len(t) // 2] + n[: len(t) // 2], simhash.fingerprint(t).hex(), simhash.likeness(simhash.fingerprint(t), simhash.fingerprint(n))))
    assert got == sorted(want)
    assert simhash.fingerprints_with_edits(docs_of(spark, [])).collect() == []
    first = simhash.fingerprints_with_edits(docs_of(spark, [(None, "a"), (3, "b c"), (None, None), (1, "d")]), 2).select("doc_id", "edited_text").collect()
    assert sorted(map(tuple, first), key=str) == [(1, "d"), (3, "b "), (None, ""), (None, "a")]


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item"), (3, None), (4, "short, ITEM!")], "item_id long, text string")
    rows = [(1, "zero One two-three four five six seven eight nine ten"), (2, "a short item; short item"), (3, "one two three"), (4, None), (5, ""), (6, "shortitem"), (2, "a short item; short item")]
    for most in (decontaminate.BROADCAST_BYTES, 0):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.report(decontaminate.hits(docs_of(spark, rows), bench, broadcast_bytes=most)).collect()}
        assert got == {1: (11, 10, ["1"], True), 2: (5, 4, ["2", "4"], True), 3: (3, 0, [], False), 4: (0, 0, [], False), 5: (0, 0, [], False), 6: (1, 0, [], False)}
    assert decontaminate.hits(docs_of(spark, []), bench).collect() == []


def test_reply_trees(spark):
    rows = [("t", 1, None, 0.0, "user", "q"), ("t", 2, 1, 1.0, "assistant", "a<b"), ("t", 3, 1, 2.0, "assistant", "\\l"), ("t", 4, 2, 5.0, "user", None), ("t", 8, 9, 0.0, "user", "loop"), ("t", 9, 8, 0.0, "user", "loop")]
    nodes = spark.createDataFrame([("x" + r[0], *r[1:]) for r in rows], "tree string, node long, parent long, score double, role string, text string")
    found = chat_format.paths(nodes)
    assert sorted((r.path, r.path_score) for r in found.collect()) == [([1, 2, 4], 6.0), ([1, 3], 2.0)]
    out = chat_format.formatted(nodes, chat_format.best_paths(found, None))
    back = {r["rank"]: r for r in chat_format.read_back(out).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", "q"), ("assistant", "a<b"), ("user", "")] and back[1].loss_text == "a<b"
    assert back[2].loss_text == "\\l"


def test_quality_holds_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    out = quality_fm.op2_quality_fm(spark, "/root/testdata/sf0.1")
    rows = out.where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9, auc
    assert out.count() == docs.count()


def test_language_holds_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    out = language_id.op10_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id").where("lang_pred <> 'und'").collect()
    right = sum(r.lang == r.lang_pred for r in out) / len(out)
    assert right > 0.93, right
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    odd = language_id.identify(docs_of(spark, ODD).withColumn("lang", F.lit("en"))).collect()
    assert {r.doc_id: r.lang_pred for r in odd}[2] == "und" and len(odd) == len(ODD)
    assert {r.lang_pred for r in language_id.identify(docs_of(spark, ODD).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_entries_are_digests(spark):
    r = bpe.digests(bpe.encode(docs_of(spark, [(1, "a b")]), bpe.word_bpe_path())).first()
    ids = bpe.loaded(bpe.word_bpe_path()).encode("a b")
    assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, memoryview(ids).cast("i"))).encode()).hexdigest() and r.n_tokens == len(ids) // 4 and math.isfinite(r.n_tokens)
