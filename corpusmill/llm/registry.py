"""Queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from corpusmill.llm import bpe, covertree, decontaminate, divergence, html, jaccard, language, pitman_yor, shard, substring, toxicity, warc, whitening

_MODULES = {
    "op1_html_extraction": html,
    "op2_substring_dedup": substring,
    "op3_jaccard_join": jaccard,
    "op4_embedding_dedup": covertree,
    "op5_shard": shard,
    "op6_toxicity": toxicity,
    "op7_language_id": language,
    "op8_decontaminate": decontaminate,
    "op9_bpe": bpe,
    "op10_warc": warc,
    "op11_lm_scoring": pitman_yor,
    "op12_whitening": whitening,
    "op13_divergence": divergence,
}


def queries() -> dict:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
