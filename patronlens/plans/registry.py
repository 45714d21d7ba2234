"""Named queries and the SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from patronlens.plans.driver_tables import Shop
from patronlens.plans.views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, person: str = "customer"):
    """Register ``fn(shop)`` under ``name``; ``sql`` may use the views of ``views.py``."""

    def register(fn: Callable[[Shop], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Shop(spark, folder, person))
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def with_views(sql: str) -> str:
    """``sql`` behind the definitions of the views it uses, directly or through other views."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b[vy]_\w+\b", text)):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    body = sql.strip()
    recursive = "RECURSIVE " if re.match(r"WITH\s+RECURSIVE\b", body, re.I) or any(
        "RECURSIVE" in VIEWS[n] for n in needed
    ) else ""
    body = re.sub(r"^WITH\s+(RECURSIVE\s+)?", ", ", body, count=1, flags=re.I)
    views = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    return f"WITH {recursive}{views}\n{body}"
