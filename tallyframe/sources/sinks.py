"""Writers: one output per run swapped as a whole, statistics as the completion marker, null-preserving JSON."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_run(entities: Mapping[str, DataFrame], root: str, run_id: str) -> DataFrame:
    """Write the run's entities as a new version, then its marker with the row counts.

    Readers go by the newest marker (``read_run``), which Spark's committer shows as a whole or not at all: while a version
    is being written, and if that breaks off, the one before it stays in force for every entity.
    """
    version, stats = f"{time.time_ns():020d}", None
    for name, df in entities.items():
        own = df.drop("run_id", "version")
        path = f"{root}/{name}/run_id={run_id}/version={version}"
        own.write.parquet(path)
        row = df.sparkSession.read.schema(own.schema).parquet(path).agg(F.count("*").alias("n_rows")).select(F.lit(run_id).alias("run_id"), F.lit(version).alias("version"), F.lit(name).alias("entity"), "n_rows")
        stats = row if stats is None else stats.unionByName(row)
    stats.coalesce(1).write.parquet(f"{root}/_stats/run_id={run_id}/version={version}")
    return stats.drop("version")


def run_stats(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """version, entity and n_rows of the run's newest whole version; a few rows."""
    rows = spark.read.schema("entity string, n_rows bigint, version string").parquet(f"{root}/_stats/run_id={run_id}")
    return rows.join(F.broadcast(rows.agg(F.max("version").alias("version"))), "version", "left_semi")


def read_run(spark: SparkSession, root: str, run_id: str) -> dict[str, DataFrame]:
    """The entities of the run's newest whole version."""
    return {r["entity"]: spark.read.parquet(f"{root}/{r['entity']}/run_id={run_id}/version={r['version']}") for r in run_stats(spark, root, run_id).collect()}


def audit_json(*columns: Column | str) -> Column:
    """The row as JSON with its NULLs."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_summary(df: DataFrame, path: str) -> None:
    """A flat run summary as Parquet and CSV."""
    df.coalesce(1).write.mode("overwrite").parquet(f"{path}/parquet")
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
