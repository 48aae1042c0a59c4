"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from lexmill.llm import decontamination, exact_dedup, html_text, minhash, mixing, ngrams, repeats, secrets, sharding, toxicity

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_mixing": mixing.op3_mixing,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_repeats": repeats.op5_repeats,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_lm_scores": ngrams.op7_lm_scores,
    "op8_html_text": html_text.op8_html_text,
    "op9_secrets": secrets.op9_secrets,
    "op10_sharding": sharding.op10_sharding,
}

ORACLE_SQL = {
    "op2_decontamination": decontamination.SQL_OP2,
    "op3_mixing": mixing.SQL_OP3,
    "op4_exact_dedup": exact_dedup.SQL_OP4,
}
