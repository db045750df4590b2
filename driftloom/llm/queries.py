"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import line_dedup, mixing, ngram_join, packing, quality_rules, secret_scan, token_files, topk, toxicity, url_filter

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_mixing": mixing.op2_mixing,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_token_files": token_files.op4_token_files,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_top_k": topk.op10_top_k,
}
ORACLE_SQL = {
    "op2_mixing": mixing.OP2_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op9_quality_rules": quality_rules.OP9_SQL,
    "op10_top_k": topk.OP10_SQL,
}
