"""Slugs and categories of whole texts, against plain versions."""

import re

from newsloom.functions import text as T
from newsloom.plans import catalog

from .test_engine import SF


def test_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    low = {r.doc_id: f"{r.text} {r.source}".lower() for r in docs}
    want = {i: next((k for k, words in T.CATEGORY_RULES.items() if re.search(words, t)), T.DEFAULT_CATEGORY) for i, t in low.items()}
    got = {r.doc_id: r.category for r in catalog.queries()["t15_category_text"](spark, SF).collect()}
    assert got == want
    slugs = {r.doc_id: r.slug for r in catalog.queries()["t1_slug_text"](spark, SF).collect()}
    assert slugs == {r.doc_id: re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", r.text.lower())) for r in docs}
