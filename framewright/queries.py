"""All registered queries on the provided tables, gathered from the operator families."""

from __future__ import annotations

from framewright.registry import language, retrieval, serving

_FAMILIES = (retrieval, language, serving)

QUERIES = {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}
ORACLE_SQL = {name: sql for family in _FAMILIES for name, sql in family.ORACLE_SQL.items()}
