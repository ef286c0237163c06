"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from mapweave.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10

QUERIES = {
    "op1_license_scan": op1.run,
    "op2_near_dedup": op2.run,
    "op3_secret_scan": op3.run,
    "op4_token_counts": op4.run,
    "op5_top_k": op5.run,
    "op6_decontaminate": op6.run,
    "op7_warc": op7.run,
    "op8_toxicity": op8.run,
    "op9_bpe": op9.run,
    "op10_language_id": op10.run,
}

ORACLES: dict[str, str] = {"op1_license_scan": op1.ORACLE, "op2_near_dedup": op2.ORACLE, "op6_decontaminate": op6.ORACLE, "op5_top_k": op5.ORACLE, "op7_warc": op7.ORACLE}
