"""Queries of this subpackage (the pipeline is registered beside it), and the SQL of those that SQL can express.

No SQL: op1 and op5 (learned weights over counted statistics), op4 (XXH64 and majority bits), op7 and
op10 (learned models), op8 (byte-pair merges). Tests hold these against brute force.
"""

from __future__ import annotations

from . import chat_format, decontaminate, license_scan, mixing, pii, quality_model, quality_rules, simhash, sql, token_count, url_filter

QUERIES = {
    "op1_license_scan": license_scan.query,
    "op2_url_filter": url_filter.query,
    "op3_mixing": mixing.query,
    "op4_simhash_dedup": simhash.query,
    "op5_quality_rules": quality_rules.query,
    "op6_chat_format": chat_format.query,
    "op7_pii": pii.query,
    "op8_token_count": token_count.query,
    "op9_decontamination": decontaminate.query,
    "op10_quality_model": quality_model.query,
}

ORACLE_SQL = {"op2_url_filter": sql.urls(), "op3_mixing": sql.mixing(), "op6_chat_format": sql.CHAT, "op9_decontamination": sql.DECONTAMINATION}
