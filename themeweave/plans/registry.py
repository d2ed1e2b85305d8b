"""All named queries and their SQL oracles."""

from __future__ import annotations

from themeweave.plans import text_queries, theme_queries, time_queries, vector_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in (text_queries, theme_queries, time_queries, vector_queries):
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
