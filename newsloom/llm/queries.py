"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from newsloom.llm import bpe, chat, classifier, lm, media, neardup, packing, quality, substring, tokens

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_media_columns": media.query,
    "op3_quality_classifier": classifier.query,
    "op4_token_files": tokens.query,
    "op5_preference_format": chat.query,
    "op6_packing": packing.query,
    "op7_byte_bpe": bpe.query,
    "op8_substring_dedup": substring.query,
    "op9_lm_scores": lm.query,
    "op10_near_duplicates": neardup.query,
}
ORACLES = {
    "op1_quality_rules": quality.ORACLE_SQL,
    "op5_preference_format": chat.ORACLE_SQL,
    "op8_substring_dedup": substring.ORACLE_SQL,
    "op10_near_duplicates": neardup.ORACLE_SQL,
}
