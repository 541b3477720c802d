"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame``
and, where one exists, an equivalent DuckDB SQL string over the same tables.

Output columns are aliased identically on both sides; floats are rounded and
arrays are rendered as strings so results compare exactly.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | Callable[[], str] | None
    operators: str  # SURVEY ids covered

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return self.sql() if callable(self.sql) else self.sql


REGISTRY: dict[str, Query] = {}


def register(name: str, operators: str, sql: str | Callable[[], str] | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, operators)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    from quarry.catalog import web, text, retrieval, dialog, training, streams, files  # noqa: F401
    return REGISTRY
