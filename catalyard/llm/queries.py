"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import alignment, chat_format, context_tree, fingerprint, language_id, mixing, negatives, packing, quality_rules, simhash, tokens, toxicity, url_filter

QUERIES = {
    "op1_context_tree": context_tree.op1_context_tree,
    "op2_token_ids": tokens.op2_token_ids,
    "op3_fingerprint": fingerprint.op3_fingerprint,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_mixing": mixing.op6_mixing,
    "op7_simhash": simhash.op7_simhash,
    "op8_packing": packing.op8_packing,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_alignment": alignment.op11_alignment,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_language_id": language_id.op13_language_id,
}
ORACLE_SQL = {"op5_url_filter": url_filter.ORACLE, "op9_chat_format": chat_format.ORACLE, "op12_hard_negatives": negatives.ORACLE}
