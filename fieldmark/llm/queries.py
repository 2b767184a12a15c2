"""Queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from fieldmark.llm import (
    chat_windows, decontamination, html_extraction, lexical_search, ngram_join, packing, pii, quality_rules, sharding,
    suffix_dedup, url_rules, weak_labels, whitening,
)

QUERIES = {
    "op7_weak_labels": weak_labels.op7,
    "op2_suffix_dedup": suffix_dedup.op2,
    "op5_chat_windows": chat_windows.op5,
    "op4_url_rules": url_rules.op4,
    "op3_sharding": sharding.op3,
    "op1_decontamination": decontamination.op1,
    "op8_pii": pii.op8,
    "op6_packing": packing.op6,
    "op9_quality_rules": quality_rules.op9,
    "op10_ngram_join": ngram_join.op10,
    "op11_lexical_search": lexical_search.op11,
    "op12_html_extraction": html_extraction.op12,
    "op13_whitening": whitening.op13,
}
ORACLES = {
    "op5_chat_windows": chat_windows.ORACLE,
    "op3_sharding": sharding.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
    "op10_ngram_join": ngram_join.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
}
