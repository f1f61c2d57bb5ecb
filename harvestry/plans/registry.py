"""Registry of named queries: a Spark builder and (when SQL can say it) the
equivalent DuckDB oracle text.

Oracle SQL may reference derived views by name (``farm_obs``, ``merged``,
``features`` ...); ``oracle_text`` prefixes the needed definitions as CTEs in
dependency order, so every oracle string runs on the raw driver tables only.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from harvestry.plans.catalog import Catalog


@dataclass
class Query:
    name: str
    build: Callable[[Catalog], DataFrame]
    sql: str | None
    ops: str = ""


REGISTRY: dict[str, Query] = {}
VIEWS: dict[str, str] = {}


def query(name: str, sql: str | None = None, ops: str = ""):
    def deco(fn: Callable[[Catalog], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, ops)
        return fn
    return deco


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def _deps(sql: str) -> list[str]:
    found = []
    for v in VIEWS:
        if re.search(rf"\b{re.escape(v)}\b", sql):
            found.append(v)
    return found


def oracle_text(sql: str) -> str:
    order: list[str] = []

    def visit(v: str, stack: tuple = ()):
        if v in order:
            return
        if v in stack:
            raise ValueError(f"cyclic view {v}")
        for d in _deps(VIEWS[v]):
            if d != v:
                visit(d, stack + (v,))
        order.append(v)

    for d in _deps(sql):
        visit(d)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{v} as (\n{VIEWS[v].strip()}\n)" for v in order)
    body = sql.strip()
    if re.match(r"(?i)^with\s", body):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


def load_all() -> dict[str, Query]:
    """Import every suite module so that its queries register."""
    from harvestry.plans import (  # noqa: F401
        suite_sources, suite_cleaning, suite_quality, suite_joins, suite_aggregates,
        suite_ranking, suite_features, suite_profiling, suite_models, suite_scoring,
        suite_streaming,
    )
    return REGISTRY
