"""Queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from vireo.llm import alignment, ann, audit, bpe, chat, jaccard, langid, lm, oracles, packing, quality, substrings, tokencount, warc

QUERIES: dict = {
    "op1_token_counts": tokencount.op1_token_counts,
    "op2_nearest": ann.op2_nearest,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_bpe_round_trip": bpe.op5_bpe_round_trip,
    "op6_lm_scoring": lm.op6_lm_scoring,
    "op7_language_id": langid.op7_language_id,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_packing": packing.op9_packing,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_warc": warc.op12_warc,
    "op13_alignment": alignment.op13_alignment,
}
ORACLES: dict[str, str] = oracles.ORACLES | {"op2_nearest": ann.ORACLE_OP2, "op8_chat_formatting": chat.ORACLE_OP8, "op11_filter_audit": audit.ORACLE_OP11, "op12_warc": warc.ORACLE_OP12}
