"""Queries on the given tables, each with the SQL that answers it independently where there is one."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """The given tables by name: ``tables.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self._folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")


class Query(NamedTuple):
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of :class:`Tables` under its own name."""

    def register(build: Callable[[Tables], DataFrame]):
        key = name or build.__name__
        assert key not in QUERIES, key
        QUERIES[key] = Query(build, sql)
        return build

    return register
