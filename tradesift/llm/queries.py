"""The registered queries of the corpus operators and their expected rows in SQL."""

from __future__ import annotations

from tradesift.llm import decontamination, embedding_dedup, language_id, line_dedup, lm_scoring, near_dedup, packing, periodic_runs
from tradesift.llm import pii_anchors, secret_scan, source_divergence, substring_dedup, token_counts

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op6_packing": packing.op6_packing,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_pii_anchors": pii_anchors.op11_pii_anchors,
    "op12_source_divergence": source_divergence.op12_source_divergence,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

SQL = {
    "op2_embedding_dedup": embedding_dedup.OP2_SQL,
    "op3_decontamination": decontamination.OP3_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op8_substring_dedup": substring_dedup.OP8_SQL,
    "op9_near_dedup": near_dedup.OP9_SQL,
    "op11_pii_anchors": pii_anchors.OP11_SQL,
    "op12_source_divergence": source_divergence.OP12_SQL,
    "op13_periodic_runs": periodic_runs.OP13_SQL,
}
