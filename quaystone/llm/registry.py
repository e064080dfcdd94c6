"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quaystone.llm import chat_format, decontaminate, license_scan, line_dedup, lm_score, near_dedup, periodic_runs, phrases, quality_rules, secret_scan, sentence_pieces, suffix_dedup, url_filter

MODULES = (lm_score, decontaminate, chat_format, secret_scan, url_filter, sentence_pieces, suffix_dedup, quality_rules, license_scan, near_dedup, periodic_runs, line_dedup, phrases)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
