"""The registered queries of this folder and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from meshledger.llm import (
    brown_lm, decontaminate, exact_dedup, hard_negatives, html_text, mixing, secret_scan, simhash, substring_dedup,
    suffix_repeats, token_files, toxicity, whitening,
)

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_mixing": mixing.op2_mixing,
    "op3_brown_lm": brown_lm.op3_brown_lm,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_html_text": html_text.op8_html_text,
    "op9_suffix_dedup": suffix_repeats.op9_suffix_dedup,
    "op10_token_ids": token_files.op10_token_ids,
    "op11_secrets": secret_scan.op11_secrets,
    "op12_whitening": whitening.op12_whitening,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLES = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op9_suffix_dedup": suffix_repeats.OP9_SQL,
    "op11_secrets": secret_scan.OP11_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
