"""All panel queries and their DuckDB equivalents, by name."""

from __future__ import annotations

from saltern.plans import context_queries, feature_queries, model_queries, portfolio_queries, relational_queries, research_queries, search_queries, temporal_queries

_PARTS = (feature_queries, context_queries, temporal_queries, relational_queries, portfolio_queries, research_queries, search_queries, model_queries)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.REG.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.REG.oracle.items()}
