"""All registered queries of the engine, by name, with the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules that offer ``QUERIES`` and ``ORACLE``.
MODULES = ["grouped", "tokens", "batch", "audit", "metrics", "ranking", "text", "cells", "streaming", "sources", "extra", "rules", "workbooks"]


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"quillon.plans.{name}"), attribute)
        twice = found.keys() & part.keys()
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        found.update(part)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLE")
