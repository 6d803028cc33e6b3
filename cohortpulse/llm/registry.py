"""Queries over the driver's tables, one per operator, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from cohortpulse.llm import (
    alignment,
    conversations,
    exact_dedup,
    language_id,
    licenses,
    line_dedup,
    mixing,
    near_dedup,
    neighbours,
    packing,
    substring_dedup,
    suffix_dedup,
    toxicity,
)

LLM_QUERIES = {
    "op1_source_mix": mixing.op1_source_mix,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_nearest": neighbours.op5_nearest,
    "op6_packing": packing.op6_packing,
    "op7_language_id": language_id.op7_language_id,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_alignment": alignment.op12_alignment,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

LLM_ORACLE = {
    "op1_source_mix": mixing.ORACLE,
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op8_near_dedup": near_dedup.ORACLE,
    "op9_suffix_dedup": suffix_dedup.ORACLE,
    "op11_line_dedup": line_dedup.ORACLE,
    "op13_conversation_repair": conversations.ORACLE,
}
