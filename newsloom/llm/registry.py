"""The queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op5_bpe
from .chat_format import OP7_SQL, op7_chat_format
from .decontaminate import OP8_SQL, op8_decontaminate
from .embedding_forest import op11_embedding_forest
from .katz_lm import op3_katz_lm
from .language_id import op10_language_id
from .merkle import OP13_SQL, op13_merkle
from .minhash_dedup import op6_minhash_dedup
from .periodic_runs import op12_periodic_runs
from .quality_fm import op2_quality_fm
from .simhash import op1_simhash
from .substring_dedup import OP4_SQL, op4_substring_dedup
from .unigram_counts import op9_unigram_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_quality_fm, op3_katz_lm, op4_substring_dedup, op5_bpe, op6_minhash_dedup, op7_chat_format, op8_decontaminate, op9_unigram_counts, op10_language_id, op11_embedding_forest, op12_periodic_runs, op13_merkle)}


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": OP4_SQL, "op7_chat_format": OP7_SQL, "op8_decontaminate": OP8_SQL, "op13_merkle": OP13_SQL}
