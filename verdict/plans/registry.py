"""Registry of catalogue queries: key -> (Spark builder, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import table


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: str


_REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, operators: str = ""):
    def deco(fn):
        if name in _REGISTRY:
            raise ValueError(f"duplicate query key {name}")
        _REGISTRY[name] = Query(name, fn, sql, operators)
        return fn
    return deco


def all_queries() -> dict[str, Query]:
    from . import catalog  # noqa: F401  (registers everything)
    return dict(_REGISTRY)


class Tables:
    """Lazy access to the supplied parquet tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self.spark, self.sf_dir, name)
