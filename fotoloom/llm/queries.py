"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, jaccard_join, language_id, mixing, substring_dedup, suffix_dedup, token_counts, token_output, topk_search, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_topk_search": topk_search.op4_topk_search,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_warc": warc.op6_warc,
    "op7_language_id": language_id.op7_language_id,
    "op8_token_output": token_output.op8_token_output,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_token_counts": token_counts.op10_token_counts,
}
ORACLE_SQL = {
    "op1_suffix_dedup": suffix_dedup.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op3_jaccard_join": jaccard_join.OP3_SQL,
    "op4_topk_search": topk_search.OP4_SQL,
    "op5_decontamination": decontamination.OP5_SQL,
    "op9_substring_dedup": substring_dedup.OP9_SQL,
}
