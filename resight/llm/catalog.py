"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from resight.llm import chat, decontamination, html_text, language, packing, quality_model, quality_rules, runs, simhash, token_counts, toxicity, url_filter, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat": chat.op1_chat,
        "op2_simhash": simhash.op2_simhash,
        "op3_packing": packing.op3_packing,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_language": language.op9_language,
        "op10_quality": quality_model.op10_quality,
        "op11_runs": runs.op11_runs,
        "op12_html": html_text.op12_html,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    """Missing are XXH64, tokenizers, linear programs, automata, fitted models, HTML parsing and eigenvectors, which SQL can't
    express; tests hold those operators against brute force, round trips and held-out rows."""
    return {
        "op1_chat": chat.OP1_SQL,
        "op4_quality_rules": quality_rules.OP4_SQL,
        "op5_url_filter": url_filter.OP5_SQL,
    }
