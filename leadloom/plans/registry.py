"""The library's own queries: name -> (callable, oracle SQL or None)."""

from __future__ import annotations

import importlib

#: Modules of leadloom.plans that declare QUERIES and ORACLE_SQL.
MODULES: list[str] = ["kpi_queries", "lead_queries", "text_queries", "data_queries", "more_queries", "outreach_queries", "source_queries"]


def collect() -> tuple[dict, dict]:
    queries, oracle = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"leadloom.plans.{name}")
        queries.update(module.QUERIES)
        oracle.update(module.ORACLE_SQL)
    return queries, oracle
