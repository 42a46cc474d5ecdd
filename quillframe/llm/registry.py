"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from quillframe.llm import (
    decontaminate, html, language, line_dedup, near_dup, packing, quality, secrets, tokens, toxicity,
)

MODULES = {
    "op1_line_dedup": line_dedup,
    "op2_quality_rules": quality,
    "op3_toxicity": toxicity,
    "op4_secrets": secrets,
    "op5_tokens": tokens,
    "op6_near_dup": near_dup,
    "op7_packing": packing,
    "op8_decontaminate": decontaminate,
    "op9_language_id": language,
    "op10_html_text": html,
}


def queries() -> dict:
    return {name: module.query for name, module in MODULES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for name, module in MODULES.items() if (sql := getattr(module, "SQL", None))}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
