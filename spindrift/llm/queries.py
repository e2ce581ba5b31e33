"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, divergence, exact_dedup, fim, html_extract, lm_score, media, near_dedup, packing, quality, token_count, topk, url_filter

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_html_text": html_extract.op2_html_text,
    "op3_token_count": token_count.op3_token_count,
    "op4_quality": quality.op4_quality,
    "op5_packing": packing.op5_packing,
    "op6_lm_score": lm_score.op6_lm_score,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_media": media.op10_media,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_exact_topk": topk.op12_exact_topk,
    "op13_source_divergence": divergence.op13_source_divergence,
}

#: None where SQL cannot express a query; these are tested against brute force.
ORACLE_SQL = {
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op8_near_dedup": near_dedup.OP8_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
    "op11_fill_in_middle": fim.OP11_SQL,
    "op12_exact_topk": topk.OP12_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
