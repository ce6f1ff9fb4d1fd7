"""Every query over the driver's tables, by name, with the SQL it must agree with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_MODULES = ("scalar", "relational", "windowed", "scans", "products", "audits", "reports", "builds", "layers", "registry_products")


class Tables:
    """The driver's tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a query by its function's name; ``sql`` is what DuckDB runs on the same tables."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            ORACLES[build.__name__] = sql
        return build

    return add


def load() -> None:
    for name in _MODULES:
        importlib.import_module(f"tallyframe.queries.{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["mrt26_recruiting_competition"](spark, sf_dir)
