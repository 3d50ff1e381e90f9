"""Golden vectors of the text functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions import text as T


def values(spark, rows, f, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_slugs(spark):
    rows = ["Hello, World!", "  A--B  ", "Café 24", "हिंदी", None]
    assert values(spark, rows, T.slug) == ["hello-world", "a-b", "caf-24", "", None]
    assert values(spark, rows, T.raw_slug) == ["hello-world-", "-a-b-", "caf-24", "-", None]


def test_categories(spark):
    rows = ["India wins cricket final", "Transport strike", "Multiple vote counts", "Chief minister said so", "Rupee slides", "Election results", "Award season opens", "Quiet morning"]
    assert values(spark, rows, T.category) == ["sports", "sports", "sports", "tech", "business", "politics", "entertainment", "world"]


def test_languages(spark):
    assert values(spark, ["かな漢字", "漢字", "मैच", "plain", "", None], T.script_language) == ["ja", "zh", "hi", None, None, None]
    assert values(spark, ["en", "mr", "", None], lambda c: T.language_tag(c, F.lit("हिंदी"))) == ["hi", "mr", "hi", "hi"]
    assert values(spark, ["ABP Ananda", "Geo Urdu Jang", "Daily News"], T.source_language) == ["bn", "ur", "en"]
    assert values(spark, ["en-US", "de-XX", "xx", None], T.locale_country) == ["US", "DE", "IN", "IN"]


def test_paragraphs(spark):
    exact, contained = (lambda rows, f=f: values(spark, rows, f, "array<string>") for f in (T.distinct_paragraphs, T.uncontained_paragraphs))
    lists = [["A b c.", "a  B C", "x"], ["A b c", "A b"], ["A b", "A b c"], ["!!!", "x"], []]
    assert exact(lists) == [["A b c.", "x"], ["A b c", "A b"], ["A b", "A b c"], ["x"], []]
    assert contained(lists) == [["A b c.", "x"], ["A b c"], ["A b"], ["x"], []]
    assert values(spark, ["a\n \nb\n\n\n", "", None], T.paragraphs) == [["a", "b"], [], None]


def test_html(spark):
    rows = ["<p>One</p> <P class=x>Two<br/>three</p>", "plain", "<b></b>"]
    assert values(spark, rows, T.html_text) == ["One\n\nTwo\nthree", "plain", ""]
    assert values(spark, ['<IMG alt="a" src=\'u.png\'>', "<p>"], T.first_image) == ["u.png", None]
    assert values(spark, ["a<b>&c"], T.escaped_html) == ["a&lt;b&gt;&amp;c"]


def test_tokens_and_likeness(spark):
    assert values(spark, ["alpha bravo charlie delta echo", "one two six", "Alpha ALPHA alpha bravo"], lambda c: F.array_sort(T.tokens(c))) == [["alpha", "bravo", "charlie", "delta"], [], ["alpha", "bravo"]]


def test_urls(spark):
    rows = ["https://youtu.be/abc/x", "https://www.youtube.com/watch?v=q1", "https://youtube.com/shorts/s1?x", "https://example.com/a", "::bad::"]
    assert values(spark, rows, T.embed_url) == ["https://www.youtube.com/embed/abc", "https://www.youtube.com/embed/q1", "https://www.youtube.com/embed/s1", None, None]
    assert values(spark, [" ", "ftp://x/a.MP4", "ftp://x", "HTTP://x", None], T.is_playable) == [False, True, False, True, False]


def test_times(spark):
    assert values(spark, [0.0, 3661.5], T.srt_time, "double") == ["00:00:00,000", "01:01:01,500"]
    got = values(spark, ["Tue, 02 Jan 2024 03:04:05 GMT", "2024-01-02T03:04:05Z", "soon", None], lambda c: F.date_format(T.feed_time(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2024-01-02 03:04:05", "2024-01-02 03:04:05", None, None]
    minutes = values(spark, [1, 59, 60, 1439, 1440], lambda c: T.age_label(F.lit("2024-01-03").cast("timestamp") - F.make_dt_interval(mins=c), F.lit("2024-01-03").cast("timestamp")), "int")
    assert minutes == ["Just now", "59m ago", "1h ago", "23h ago", "2 Jan"]


def test_conditions(spark):
    assert values(spark, [None, 0.0, 0.29, 0.3, 0.59, 0.6], T.risk_level, "double") == ["low", "low", "low", "medium", "medium", "high"]
    assert values(spark, ["DRAFT", "PENDING_REVIEW", "ARCHIVED", "none"], lambda c: T.is_transition(c, F.lit("PENDING_REVIEW"))) == [True, False, False, False]
    assert values(spark, ["Status code 404", "ENOTFOUND x", "status code 500", None], T.is_dead_source) == [True, True, False, False]


def chunks(text, most):
    import re

    whole = re.sub(r"\s+", " ", text).strip()
    if not whole:
        return ["Video update."]
    out, cur = [], ""
    for s in re.split(r"(?<=[.!?])\s+", whole):
        longer = f"{cur} {s}" if cur else s
        if len(longer) <= most:
            cur = longer
            continue
        out += [cur] * bool(cur)
        parts = [s[i : i + most] for i in range(0, len(s), most)]
        out, cur = out + parts[:-1], parts[-1] if parts else ""
    return (out + [cur] * bool(cur))[:40]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab .!?", max_size=60), min_size=1, max_size=20))
def test_script_chunks(spark, rows):
    assert values(spark, rows, lambda c: T.script_chunks(c, 12)) == [chunks(r, 12) for r in rows]


def test_body_round_trip(spark):
    assert values(spark, [["a", "b\"c"], []], lambda c: T.body_paragraphs(T.body_json(c)), "array<string>") == [["a", "b\"c"], []]


@pytest.mark.parametrize("long,want", [("x" * 2400, "x" * 2400), ("long", "medium\n\nlong\n\nshort")])
def test_enriched_body(spark, long, want):
    got = spark.range(1).select(T.enriched_body(F.lit(long), F.lit("medium"), F.lit("short"), F.lit("a long story is short")).alias("b")).first().b
    assert got == want if long != "long" else got.split("\n\n")[:2] == ["medium", "long"]
