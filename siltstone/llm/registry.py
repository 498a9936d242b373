"""Names of the training-data queries and their SQL."""

from __future__ import annotations

import corpus_pipeline

from siltstone.llm import queries as q
from siltstone.llm.sql import SQL


def queries() -> dict:
    return {name: getattr(q, name) for name in dir(q) if name.startswith("op")} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
