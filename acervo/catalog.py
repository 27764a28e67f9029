"""Queries of the core by name, and the SQL of those SQL can express."""

from __future__ import annotations

from acervo.plans import curations, evaluations, extraction, layouts, models, packed_values, structured, texts

_PARTS = (curations, evaluations, texts, extraction, layouts, structured, models)
QUERIES = {"p3_found": packed_values.p3_found} | {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
