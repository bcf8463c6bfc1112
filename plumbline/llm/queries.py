"""The subpackage's queries and their SQL, for the driver's registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op13_token_alignment
from .clustering import op11_delta_lloyd, op11_sql
from .compaction import op2_size_tiered_compaction
from .hnsw import op8_hnsw_search
from .line_dedup import op3_line_dedup
from .mixing import op9_mixing, op9_sql
from .ngram_join import op5_ngram_join
from .packing import op10_best_fit_packing
from .quality_rules import op6_quality_rules
from .recurrent import op12_recurrent_lm
from .secret_scan import op1_secret_scan
from .toxicity import op7_toxicity
from .url_rules import op4_url_rules


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_size_tiered_compaction": op2_size_tiered_compaction,
        "op3_line_dedup": op3_line_dedup,
        "op4_url_rules": op4_url_rules,
        "op5_ngram_join": op5_ngram_join,
        "op6_quality_rules": op6_quality_rules,
        "op7_toxicity": op7_toxicity,
        "op8_hnsw_search": op8_hnsw_search,
        "op9_mixing": op9_mixing,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_delta_lloyd": op11_delta_lloyd,
        "op12_recurrent_lm": op12_recurrent_lm,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": op9_sql(), "op11_delta_lloyd": op11_sql()}
