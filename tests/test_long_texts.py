"""Paragraph dedup of long texts."""

import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions import text as T


def test_distinct_paragraphs_of_many_lines(spark):
    lines = [f"Line {i * 7919 % 60_000}!" for i in range(100_000)]
    cases = [lines, [], ["", "!!"], ["b", "a", "B.", "c", "A"], None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x array<string>")
    began = time.time()
    got = {r.i: r.out for r in df.select("i", T.distinct_paragraphs(F.col("x")).alias("out")).collect()}
    assert time.time() - began < 30
    assert got == {0: lines[:60_000], 1: [], 2: [], 3: ["b", "a", "c"], 4: []}


def held_by_loop(keys):
    kept = []
    for i, k in enumerate(keys):
        if k and not any(k in keys[o] or keys[o] in k for o in kept):
            kept.append(i)
    return kept


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab é𝄞", max_size=6), max_size=30))
def test_keys_apart(keys):
    assert T._apart(keys) == held_by_loop(keys)


def test_uncontained_paragraphs_of_many_lines(spark):
    lines = [f"word{i * 7919 % 60_000:05d} and more" for i in range(100_000)] + ["Word00007", "x word00008 and more x", "new"]
    few = ["one two", "two", "three one two", "", "four", "Four!"]
    cases = [lines, few, few * 20, [], None, ["!"] * 100]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x array<string>")
    began = time.time()
    got = {r.i: r.out for r in df.select("i", T.uncontained_paragraphs(F.col("x")).alias("out")).collect()}
    assert time.time() - began < 30
    assert got == {0: [*lines[:60_000], "new"], 1: ["one two", "four"], 2: ["one two", "four"], 3: [], 4: None, 5: []}
    texts = df.where("i BETWEEN 1 AND 2").select("i", F.sort_array(T.uncontained_paragraphs(F.col("x"), short=0)).alias("out"))
    assert {r.i: r.out for r in texts.collect()} == {1: ["four", "one two"], 2: ["four", "one two"]}
