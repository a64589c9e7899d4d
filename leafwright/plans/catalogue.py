"""All queries of the package by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "pair_quality_by_conversation"
#: Modules with QUERIES and ORACLES.
MODULES = ["pairs", "states", "texts", "layouts"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f"leafwright.plans.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f"leafwright.plans.{m}").ORACLES
    return out
