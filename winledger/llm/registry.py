"""The queries of this folder, and the SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from winledger.llm import (
    audit,
    chat,
    classlm,
    debruijn,
    decontaminate,
    mixing,
    mtree,
    pages,
    quality,
    simhash,
    spelling,
    suffixes,
    toxicity,
)

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_suffix_array_dedup": suffixes.op3_suffix_array_dedup,
    "op4_substring_dedup": debruijn.op4_substring_dedup,
    "op5_temperature_mixing": mixing.op5_temperature_mixing,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_exact_top_k": mtree.op7_exact_top_k,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_html_extraction": pages.op10_html_extraction,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_class_bigrams": classlm.op12_class_bigrams,
    "op13_spelling_variants": spelling.op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op4_substring_dedup": debruijn.SQL,
    "op5_temperature_mixing": mixing.SQL,
    "op6_chat_formatting": chat.SQL,
    "op7_exact_top_k": mtree.SQL,
    "op8_benchmark_decontamination": decontaminate.SQL,
    "op11_filter_audit": audit.SQL,
    "op13_spelling_variants": spelling.SQL,
}
