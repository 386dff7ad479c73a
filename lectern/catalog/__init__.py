"""Named queries over the provided tables, with the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.catalog import base

MODULES = ("texts", "planning", "retrieval", "evidence", "scans", "reports", "changes", "streams", "stores")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"lectern.catalog.{name}")


def _bind(fn: base.Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: fn(base.Tables(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _bind(fn) for name, fn in base.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(base.ORACLE)
