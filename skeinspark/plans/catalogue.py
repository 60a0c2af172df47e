"""All queries of the relational part, with their SQL for checking."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

_MODULES = ("relational", "aggregates", "scalars", "streams", "texts")


def queries() -> dict[str, Callable]:
    return {k: v for m in _MODULES for k, v in import_module(f"skeinspark.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in import_module(f"skeinspark.plans.{m}").ORACLE.items()}
