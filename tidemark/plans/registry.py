"""All queries of the bar-analytics part, by name, and their SQL."""

from __future__ import annotations

from . import basic_queries, breadth_queries, derived_queries, indicator_queries, market_queries, portfolio_queries, rule_queries, run_queries, screen_queries

MODULES = (basic_queries, breadth_queries, screen_queries, indicator_queries, market_queries, portfolio_queries, derived_queries, run_queries, rule_queries)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.Q.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.Q.sql.items()}
