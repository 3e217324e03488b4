"""Registry of named queries: a Spark callable and, where SQL can say it, equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t)`` where ``t(name)`` reads a table of the folder asked for."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        if name in REGISTRY:
            raise ValueError(f"two queries are named {name}")
        REGISTRY[name] = Query(name, run, sql, (fn.__doc__ or "").strip())
        return fn

    return add
