"""Registry of the queries exposed through ``__spark_entry__``.

Each entry pairs a Spark builder ``fn(spark, sf_dir) -> DataFrame`` with an
optional SQL oracle (DuckDB dialect, over views named like the tables).
Queries read whole tables; parameters are fixed per entry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    rows: str  # survey ids covered, e.g. "A-05 A-06"


REGISTRY: dict[str, Query] = {}


def register(name: str, rows: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, rows)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the plan modules fills the registry
    from weft.plans import corpus_q, batching_q, tensor_q, evaluate_q, runs_q, capture_q, stream_q  # noqa: F401
    return REGISTRY
