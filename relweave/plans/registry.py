"""Registry of named queries and their DuckDB oracle SQL.

A query is a function ``(spark, sf_dir) -> DataFrame`` over the test tables;
its oracle is an independent SQL text over the same tables, written by hand.
"""

from __future__ import annotations

from collections.abc import Callable

MODULES = ["q_construction", "q_noise", "q_clean", "q_joins", "q_metrics", "q_reports", "q_sensitivity", "q_misc", "q_catalog", "q_load", "q_parse", "q_extract"]

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all():
    # Importing the modules fills the registry.
    import importlib
    for m in MODULES:
        importlib.import_module(f"relweave.plans.{m}")
    return QUERIES, ORACLE
