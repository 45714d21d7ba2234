"""All registered queries; importing the modules registers them and their views."""

from patronlens.plans import fitted, learning, people, reports, tables  # noqa: F401
from patronlens.plans.registry import QUERIES, SQL, with_views

ORACLE = {name: with_views(sql) for name, sql in SQL.items()}

__all__ = ["ORACLE", "QUERIES"]
