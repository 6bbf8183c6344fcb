"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import decontamination, language_id, line_dedup, mixing, quality_rules, secret_scan, simhash, suffix_dedup, token_output, warc


def queries() -> dict:
    found = (decontamination.op1_decontamination, suffix_dedup.op2_suffix_dedup, language_id.op3_language_id, secret_scan.op4_secret_scan, token_output.op5_token_output, mixing.op6_mixing, simhash.op7_simhash, quality_rules.op8_quality_rules, line_dedup.op9_line_dedup, warc.op10_warc)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontamination.ORACLE, "op4_secret_scan": secret_scan.ORACLE, "op8_quality_rules": quality_rules.ORACLE, "op9_line_dedup": line_dedup.ORACLE}
