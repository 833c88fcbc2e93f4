"""Registry of named queries: name -> (spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import round_doubles
from ..session import apply_session_defaults


@dataclass
class QuerySpec:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


_REGISTRY: dict[str, QuerySpec] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``; doubles are rounded to 6 places."""
    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_session_defaults(spark)
            return round_doubles(fn(spark, sf_dir))
        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        if name in _REGISTRY:
            raise ValueError(f"duplicate query name {name}")
        _REGISTRY[name] = QuerySpec(name, build, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def all_queries() -> dict[str, QuerySpec]:
    from . import queries  # noqa: F401  (populates the registry)
    return dict(_REGISTRY)
