"""Queries of the text operators and their SQL, where SQL can express them."""

from __future__ import annotations

from . import bpe, decontaminate, html, langid, lines, neardup, oracles, periods, quality, resampling, secrets, sharding, substrings, toxicity


def queries() -> dict:
    return {
        "op1_html_extraction": html.op1_html_extraction,
        "op2_line_dedup": lines.op2_line_dedup,
        "op3_quality_rules": quality.op3_quality_rules,
        "op4_substring_dedup": substrings.op4_substring_dedup,
        "op5_minhash_neardup": neardup.op5_minhash_neardup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_sharding": sharding.op7_sharding,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_language_id": langid.op9_language_id,
        "op10_decontamination": decontaminate.op10_decontamination,
        "op11_importance_resampling": resampling.op11_importance_resampling,
        "op12_periodic_runs": periods.op12_periodic_runs,
        "op13_secret_scans": secrets.op13_secret_scans,
    }


def oracle_sql() -> dict:
    return {
        "op2_line_dedup": oracles.LINE_DEDUP,
        "op4_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op5_minhash_neardup": oracles.MINHASH_NEARDUP,
        "op11_importance_resampling": oracles.IMPORTANCE_RESAMPLING,
        "op12_periodic_runs": oracles.PERIODIC_RUNS,
    }
