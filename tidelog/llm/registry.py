"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import audio, chat, langid, lm, mixing, packing, quality, simhash, substring, urls

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_audio_columns": audio.op3_audio_columns,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_lm_scoring": lm.op5_lm_scoring,
    "op6_substring_dedup": substring.op6_substring_dedup,
    "op7_url_filters": urls.op7_url_filters,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_target_mixing": mixing.op10_target_mixing,
}

ORACLES = {
    "op2_quality_rules": quality.OP2_SQL,
    "op4_chat_formatting": chat.OP4_SQL,
    "op6_substring_dedup": substring.OP6_SQL,
    "op7_url_filters": urls.OP7_SQL,
}
