"""All registered queries with the SQL each equals, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of tidemark.plans, each with QUERIES and SQL.
MODULES = ("changes", "producers", "services", "observability", "scalars", "relational", "streams", "exports")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"tidemark.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"tidemark.plans.{name}").SQL
    return found
