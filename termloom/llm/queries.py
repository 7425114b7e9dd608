"""All queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import q_chat, q_decontamination, q_html, q_licenses, q_lines, q_near_dup, q_phrases, q_quality, q_simhash, q_tokens, q_vector_codes, q_warc

MODULES = (q_lines, q_quality, q_licenses, q_tokens, q_decontamination, q_near_dup, q_html, q_chat, q_warc, q_simhash, q_phrases, q_vector_codes)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
