"""Registered queries of the engine's operators, each with its SQL for an independent engine.

A query gets (spark, sf_dir) and runs over the whole tables there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.session import Session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(spark: SparkSession, sf_dir: str) -> Session:
    s = Session(spark)
    s.register_folder(sf_dir, TABLES)
    return s


def in_sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query said in the engine's SQL dialect."""
    return lambda spark, sf_dir: session(spark, sf_dir).sql(text).df


def collect() -> tuple[dict[str, Callable], dict[str, str]]:
    from tessera.registry import aggregates, frames, scalars, statements, tpch

    queries: dict[str, Callable] = {}
    oracle: dict[str, str] = {}
    for module in (tpch, scalars, aggregates, frames, statements):
        queries |= module.QUERIES
        oracle |= module.ORACLE
    return queries, oracle
