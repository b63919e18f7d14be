"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat_format, mixing, permutation_index, quality_rules, secret_scan, simhash, toxicity, url_filters, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_permutation_index": permutation_index.op1_permutation_index,
        "op2_segment_popcount": simhash.op2_segment_popcount,
        "op3_line_frequency": quality_rules.op3_line_frequency,
        "op4_revisit_resolution": warc.op4_revisit_resolution,
        "op5_redirect_equivalence": url_filters.op5_redirect_equivalence,
        "op6_labelled_neighbours": toxicity.op6_labelled_neighbours,
        "op7_distinct_words": byte_bpe.op7_distinct_words,
        "op8_randomness_battery": secret_scan.op8_randomness_battery,
        "op9_grammar_round_trip": chat_format.op9_grammar_round_trip,
        "op10_hierarchical_budget": mixing.op10_hierarchical_budget,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_frequency": quality_rules.OP3_SQL,
        "op4_revisit_resolution": warc.OP4_SQL,
        "op5_redirect_equivalence": url_filters.OP5_SQL,
        "op9_grammar_round_trip": chat_format.OP9_SQL,
        "op10_hierarchical_budget": mixing.OP10_SQL,
    }
