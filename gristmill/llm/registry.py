"""Queries and DuckDB statements of the training-data operators."""

from __future__ import annotations

from gristmill.llm import chat_format, decontamination, exact_dedup, fill_middle, html_extract, license_scan, line_dedup, minhash_dedup, packing, pii, quality_rules, resampling, toxicity

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_pii": pii.op3_pii,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_packing": packing.op5_packing,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_minhash_dedup": minhash_dedup.op10_minhash_dedup,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_exact_dedup": exact_dedup.op12_exact_dedup,
    "op13_resampling": resampling.op13_resampling,
}
ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op6_line_dedup": line_dedup.ORACLE_SQL,
    "op8_chat_format": chat_format.ORACLE_SQL,
    "op10_minhash_dedup": minhash_dedup.ORACLE_SQL,
    "op11_fill_middle": fill_middle.ORACLE_SQL,
    "op12_exact_dedup": exact_dedup.ORACLE_SQL,
    "op13_resampling": resampling.ORACLE_SQL,
}
