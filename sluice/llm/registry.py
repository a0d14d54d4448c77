"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from sluice.llm import decontaminate, fingerprints, html_text, importance, jaccard_join, lexical_search, line_dedup, packing, passages, quality, sharding, substring_dedup, token_counts

QUERIES = {
    "op1_passages": passages.query,
    "op2_packing": packing.query,
    "op5_sharding": sharding.query,
    "op3_html_text": html_text.query,
    "op4_line_dedup": line_dedup.query,
    "op6_decontaminate": decontaminate.query,
    "op7_substring_dedup": substring_dedup.query,
    "op8_token_counts": token_counts.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_quality_rules": quality.query,
    "op11_importance": importance.query,
    "op12_lexical_search": lexical_search.query,
    "op13_fingerprints": fingerprints.query,
}

ORACLES = {
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op10_quality_rules": quality.ORACLE_SQL,
    "op11_importance": importance.ORACLE_SQL,
    "op12_lexical_search": lexical_search.ORACLE_SQL,
}
