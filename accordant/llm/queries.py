"""Queries of the corpus operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from accordant.llm.decontaminate import op4_decontamination
from accordant.llm.importance import op2_importance_resampling
from accordant.llm.kneser_ney import op8_kneser_ney
from accordant.llm.linededup import op6_line_dedup
from accordant.llm.packing import op10_best_fit_packing
from accordant.llm.pii import op3_pii
from accordant.llm.quality import op9_quality_rules
from accordant.llm.simhash import op1_simhash
from accordant.llm.toxicity import op7_toxicity
from accordant.llm.urls import op5_url_filter

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_importance_resampling": op2_importance_resampling,
    "op3_pii": op3_pii,
    "op4_decontamination": op4_decontamination,
    "op5_url_filter": op5_url_filter,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_quality_rules": op9_quality_rules,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {}
