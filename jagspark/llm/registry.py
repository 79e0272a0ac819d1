"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import bpe, exact_dedup, html_text, lm, mixing, quality, secrets, simhash, token_counts, topk

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_topk": topk.op3_topk,
    "op4_quality": quality.op4_quality,
    "op5_secrets": secrets.op5_secrets,
    "op6_html_text": html_text.op6_html_text,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_lm": lm.op8_lm,
    "op9_bpe": bpe.op9_bpe,
    "op10_token_counts": token_counts.op10_token_counts,
}

ORACLE_SQL = {
    "op2_mix_sources": mixing.OP2_SQL,
    "op3_topk": topk.OP3_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
}
