"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontam, embed_dedup, gru_lm, html_text, langid, mixing, ngram_join, secrets, toxicity

QUERIES = {
    "op1_cap_filters": embed_dedup.op1_cap_filters,
    "op2_temperature_mixing": mixing.op2_temperature_mixing,
    "op3_perspective_rotation": chat.op3_perspective_rotation,
    "op4_layout_text": html_text.op4_layout_text,
    "op5_secret_scans": secrets.op5_secret_scans,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_language_id": langid.op7_language_id,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_gru_scoring": gru_lm.op9_gru_scoring,
    "op10_ngram_jaccard": ngram_join.op10_ngram_jaccard,
}

ORACLE_SQL = {
    "op1_cap_filters": embed_dedup.OP1_SQL,
    "op3_perspective_rotation": chat.OP3_SQL,
    "op5_secret_scans": secrets.OP5_SQL,
    "op10_ngram_jaccard": ngram_join.OP10_SQL,
}
