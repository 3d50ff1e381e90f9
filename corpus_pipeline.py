"""
A training corpus from `documents` in five stages. Each takes (spark, docs, sf_dir), works on all that the stage before
kept, and is written as Parquet and read again; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm.bpe import digests, encode, word_bpe_path
from newsloom.llm.common import discard, release, stored
from newsloom.llm.decontaminate import without_contaminated
from newsloom.llm.minhash_dedup import without_near_duplicates
from newsloom.llm.quality_fm import KEEP, quality
from newsloom.llm.substring_dedup import cut_repeats


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    score = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(score >= KEEP)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8) the document of least doc_id stays."""
    return without_near_duplicates(docs, 5)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that a repeated window of 35 covers go; texts without any stay as they are."""
    return cut_repeats(docs, edit=True)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text encoded, and decoded again."""
    return digests(encode(docs, word_bpe_path()))


STAGES = [
    ("quality classifier", quality_stage),
    ("near dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: Learnt scores and the tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' tables go once the next one is written, and with them the blocks that stages have cached."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{k}")
        release(spark)
        if before is not None:
            discard(before)
        before = docs
    return docs
