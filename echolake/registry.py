"""Name -> query and name -> SQL for the same rows.

A query is a function (spark, sf_dir) -> DataFrame registered by ``@query``;
``sql`` is the same in ANSI SQL over the views of the supplied tables.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reachable(spark: SparkSession) -> None:
    """Let Python workers of a session started elsewhere import this package."""
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def with_package(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reachable(spark)
        return f(spark, sf_dir)

    return run


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries named {f.__name__}")
        QUERIES[f.__name__] = with_package(f)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


for _name in ("store", "signal", "fusion", "temporal", "frames", "semantic", "scalars", "features", "edge", "tracking", "warping", "spatial", "baselines"):
    import_module(f"echolake.plans.{_name}")
