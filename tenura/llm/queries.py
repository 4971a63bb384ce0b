"""Registered queries of the text operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .hard_negatives import OP11_SQL, op11_hard_negatives
from .impact_search import OP8_SQL, op8_exact_top_k
from .lm_scoring import op6_lm_scoring
from .lsh_search import op4_nearest
from .mixing import op5_mixing, op5_sql
from .near_dup import op2_near_dup, op2_sql
from .periodic_runs import op13_periodic_runs
from .quality import op9_quality
from .secrets import op1_secrets
from .sentence_pieces import op3_sentence_pieces
from .sharding import op12_sharding
from .token_counts import op7_token_counts
from .toxicity import op10_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": op1_secrets,
        "op2_near_dup": op2_near_dup,
        "op3_sentence_pieces": op3_sentence_pieces,
        "op5_mixing": op5_mixing,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_token_counts": op7_token_counts,
        "op4_nearest": op4_nearest,
        "op8_exact_top_k": op8_exact_top_k,
        "op9_quality": op9_quality,
        "op10_toxicity": op10_toxicity,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_sharding": op12_sharding,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dup": op2_sql(), "op5_mixing": op5_sql(), "op8_exact_top_k": OP8_SQL, "op11_hard_negatives": OP11_SQL}
