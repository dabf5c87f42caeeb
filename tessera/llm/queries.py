"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import ann, byte_bpe, mixing, quality, sharding, simhash, substring, token_counts, topk, toxicity

QUERIES = {
    "op1_hypergeometric_sharding": sharding.op1_hypergeometric_sharding,
    "op2_threshold_topk": topk.op2_threshold_topk,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_posting_list_ann": ann.op5_posting_list_ann,
    "op6_relative_lz": substring.op6_relative_lz,
    "op7_quality": quality.op7_quality,
    "op8_weighted_fair_queueing": mixing.op8_weighted_fair_queueing,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_simhash_mih": simhash.op10_simhash_mih,
}

ORACLE_SQL = {
    "op2_threshold_topk": topk.OP2_SQL,
    "op6_relative_lz": substring.OP6_SQL,
    "op8_weighted_fair_queueing": mixing.OP8_SQL,
}
