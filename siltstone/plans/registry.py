"""Names of the engine's own queries and their SQL."""

from __future__ import annotations

from siltstone.plans import advice, analysis, dialogue, rasters, retrieval, serving, slots

_ALL = (analysis.plans, rasters.plans, retrieval.plans, dialogue.plans, serving.plans, slots.plans, advice.plans)


def queries() -> dict:
    return {name: query for p in _ALL for name, query in p.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for p in _ALL for name, sql in p.sql.items()}
