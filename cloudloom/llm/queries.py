"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from cloudloom.llm import decontaminate, html, language, licenses, media, negatives, packing, pii, quality, simhash, toxicity, windows

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_html_extraction": html.op2_html_extraction,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_language_id": language.op4_language_id,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_license_scans": licenses.op8_license_scans,
    "op9_personal_data": pii.op9_personal_data,
    "op10_media_columns": media.op10_media_columns,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_packing": windows.op12_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op5_benchmark_decontamination": decontaminate.OP5_SQL,
    "op8_license_scans": licenses.OP8_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
}
