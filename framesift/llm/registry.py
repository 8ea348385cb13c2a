"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import context_mixing, conversation_repair, filter_audit, fingerprints, html_text, jaccard_join, language, mixing, packing, pii, quality, token_store, url_rules

QUERIES = {
    f.__name__: f
    for f in (
        context_mixing.op1_context_mixing,
        fingerprints.op2_prefix_fingerprints,
        language.op3_language_mixture,
        mixing.op4_pfair_mixing,
        packing.op5_sum_of_squares_packing,
        pii.op6_weak_supervision_pii,
        token_store.op7_seekable_token_store,
        quality.op8_quality_trees,
        jaccard_join.op9_vertical_jaccard,
        html_text.op10_text_to_tag_ratio,
        url_rules.op11_url_trie,
        conversation_repair.op12_conversation_repair,
        filter_audit.op13_filter_audit,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op9_vertical_jaccard": jaccard_join.ORACLE_SQL,
    "op11_url_trie": url_rules.ORACLE_SQL,
    "op12_conversation_repair": conversation_repair.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
}
