"""The queries of this subpackage, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from factloom.llm import (
    bit_packing,
    bpe,
    conversation_repair,
    decontamination,
    html_extraction,
    language_id,
    ngram_join,
    oracles,
    quality_rules,
    ranked_search,
    simhash,
    substring_dedup,
    token_counts,
    url_filters,
)

QUERIES = {
    "op1_html_extraction": html_extraction.query,
    "op2_ngram_jaccard_join": ngram_join.query,
    "op3_quality_rules": quality_rules.query,
    "quality_ablations": quality_rules.ablation_query,
    "op4_token_counts": token_counts.query,
    "op5_substring_dedup": substring_dedup.query,
    "op6_bit_packing": bit_packing.query,
    "op7_url_filters": url_filters.query,
    "url_holdout": url_filters.held_out_query,
    "op8_decontamination": decontamination.query,
    "op9_language_id": language_id.query,
    "op10_bpe_automaton": bpe.query,
    "op11_ranked_search": ranked_search.query,
    "op12_conversation_repair": conversation_repair.query,
    "op13_simhash": simhash.query,
}

ORACLES: dict[str, str] = dict(oracles.ORACLES)
