"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from growret.llm import conversation_repair, decontaminate, html_extract, language_id, near_dedup, ngram_join, packing, periodic_runs, permutation_index, secrets, substring_dedup, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_language_id": language_id.op2_language_id,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_neighbours": permutation_index.op4_neighbours,
    "op5_html_text": html_extract.op5_html_text,
    "op6_packing": packing.op6_packing,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_secrets": secrets.op10_secrets,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_ngram_join": ngram_join.op13_ngram_join,
}

#: DuckDB SQL over the same tables, where SQL can express the operator on whole tables.
ORACLES: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op9_near_dedup": near_dedup.ORACLE,
    "op12_conversation_repair": conversation_repair.ORACLE,
    "op13_ngram_join": ngram_join.ORACLE,
}
