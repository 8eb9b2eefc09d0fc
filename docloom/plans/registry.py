"""Registered queries: a Spark plan over the given tables and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from docloom.session import spread


# Tables whose rows are whole texts, or become texts (``part``): worth spreading when they come as one small file.
TEXT_TABLES = {"documents", "pages", "conversations", "part"}


class Tables:
    """The given Parquet tables of one folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df) if name in TEXT_TABLES else df


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.plan(Tables(spark, folder))


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(plan: Callable[[Tables], DataFrame]):
        key = name or plan.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = Query(key, plan, sql)
        return plan

    return add
