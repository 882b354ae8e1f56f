"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame; SQL of the same name is its oracle."""

from __future__ import annotations

import importlib

MODULES = ["problems", "rows", "joins", "diagnostics", "dynamics", "streams", "extras", "models", "gridded", "outputs"]
FLAGSHIP = "leaderboard_ose"


def registry() -> tuple[dict, dict]:
    """All queries and all SQL of the core."""
    queries: dict = {}
    sql: dict = {}
    for name in MODULES:
        m = importlib.import_module(f"tidemill.plans.{name}")
        queries |= m.QUERIES
        sql |= m.SQL
    return queries, sql
