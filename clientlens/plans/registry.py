"""Registry of end-to-end queries: name → (Spark builder, oracle SQL).

Every builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole given tables.  The oracle SQL (DuckDB dialect, tables pre-registered
as views) is ``None`` for operators that cannot be written in SQL (ML
training, approximate search, streaming); those get a rows-only check.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.canonical import Client360
from ..sources.testdata import TestData


@dataclass
class Entry:
    build: Callable[[Client360], DataFrame]
    oracle: Callable[[], str] | None
    ids: str  # SURVEY §2 ids covered


REGISTRY: dict[str, Entry] = {}


def register(name: str, ids: str, oracle: Callable[[], str] | None = None):
    def deco(fn):
        REGISTRY[name] = Entry(fn, oracle, ids)
        return fn
    return deco


def c360(spark: SparkSession, sf_dir: str) -> Client360:
    return Client360(TestData(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalog  # noqa: F401  (populates REGISTRY)
    return {name: (lambda spark, sf_dir, _e=e: _e.build(c360(spark, sf_dir))) for name, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    from . import catalog  # noqa: F401
    return {name: e.oracle() for name, e in REGISTRY.items() if e.oracle is not None}
