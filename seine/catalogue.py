"""The queries over the reference's operators, by name, with their oracle SQL."""

from __future__ import annotations

from seine.registered import crawls, extracts, geography, plans, records, rejections, requests, rules, sets, shown, stores, studies, texts

_PARTS = (texts, records, plans, extracts, sets, rules, geography, crawls, requests, stores, rejections, studies, shown)
flagship = records.flagship


def queries() -> dict:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
