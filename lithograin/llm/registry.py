"""Queries of the training-data operators and their SQL, for the driver's entry module."""

from __future__ import annotations

from . import op1_jaccard, op10_html, op2_quality, op3_substring_dedup, op4_bpe, op5_pii, op6_sharding, op7_mixing, op8_suffix_dedup, op9_exact_dedup

QUERIES = {
    "op1_ngram_jaccard": op1_jaccard.op1_ngram_jaccard,
    "op10_html": op10_html.op10_html,
    "op2_quality_rules": op2_quality.op2_quality_rules,
    "op3_sentence_spans": op3_substring_dedup.op3_sentence_spans,
    "op4_bpe": op4_bpe.op4_bpe,
    "op5_pii": op5_pii.op5_pii,
    "op6_feistel_shards": op6_sharding.op6_feistel_shards,
    "op7_mixing": op7_mixing.op7_mixing,
    "op8_suffix_dedup": op8_suffix_dedup.op8_suffix_dedup,
    "op9_exact_dedup": op9_exact_dedup.op9_exact_dedup,
}

ORACLES = {
    "op1_ngram_jaccard": op1_jaccard.ORACLE_SQL,
    "op2_quality_rules": op2_quality.ORACLE_SQL,
    "op8_suffix_dedup": op8_suffix_dedup.ORACLE_SQL,
    "op9_exact_dedup": op9_exact_dedup.ORACLE_SQL,
}
