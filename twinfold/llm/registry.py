"""Queries of the training-data operators and their DuckDB forms."""

from __future__ import annotations

from . import chat, decontaminate, dedup, fingerprint, langid, lm, mixing, pii, secrets, suffix, tokens, variants, whitening

QUERIES = {
    "op7_secret_scan": secrets.op7_secret_scan,
    "op3_lm_scores": lm.op3_lm_scores,
    "op5_personal_data": pii.op5_personal_data,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op1_language_id": langid.op1_language_id,
    "op8_near_duplicates": dedup.op8_near_duplicates,
    "op2_token_files": tokens.op2_token_files,
    "op4_fingerprints": fingerprint.op4_fingerprints,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_chat_format": chat.op10_chat_format,
    "op13_spelling_variants": variants.op13_spelling_variants,
    "op12_whitening": whitening.op12_whitening,
    "op11_repeated_bytes": suffix.op11_repeated_bytes,
}
SQL = {
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op10_chat_format": chat.OP10_SQL,
    "op13_spelling_variants": variants.OP13_SQL,
}
