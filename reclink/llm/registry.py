"""Queries of the training-data operators and the SQL of those that SQL can express."""

from . import decontaminate, html_text, near_dedup, pieces, pii, quality, substring_dedup, topk, toxicity, urls

QUERIES = {
    "op1_pieces": pieces.op1_pieces,
    "op2_pii": pii.op2_pii,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_urls": urls.op6_urls,
    "op7_quality": quality.op7_quality,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_topk": topk.op9_topk,
    "op10_html": html_text.op10_html,
}
ORACLES = {
    "op4_decontamination": decontaminate.ORACLE,
    "op5_near_dedup": near_dedup.ORACLE,
    "op6_urls": urls.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op9_topk": topk.ORACLE,
}
