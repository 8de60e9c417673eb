"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import chat, decontam, filteraudit, neardup, negatives, pieces, pii, quality, spots, substrings, tokencount, topk, urlrules

QUERIES = {
    "op1_exact_top_k": topk.op1_exact_top_k,
    "op2_sentencepiece_dropout": pieces.op2_sentencepiece_dropout,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_token_counts": tokencount.op4_token_counts,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_minhash_near_dedup": neardup.op6_minhash_near_dedup,
    "op7_url_filters": urlrules.op7_url_filters,
    "op8_benchmark_decontamination": decontam.op8_benchmark_decontamination,
    "op9_pii": pii.op9_pii,
    "op10_suffix_dedup": substrings.op10_suffix_dedup,
    "op11_filter_audit": filteraudit.op11_filter_audit,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_document_fingerprints": spots.op13_document_fingerprints,
}

SQL = {
    "op1_exact_top_k": topk.SQL,
    "op3_chat_formatting": chat.SQL,
    "op7_url_filters": urlrules.SQL,
    "op8_benchmark_decontamination": decontam.SQL,
    "op11_filter_audit": filteraudit.SQL,
    "op12_hard_negatives": negatives.SQL,
    "op13_document_fingerprints": spots.SQL,
}
