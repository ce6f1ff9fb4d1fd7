"""Incremental batches: carry-forward, pending runs, bounds and append-only logs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def carry_forward(previous: DataFrame, current: DataFrame, key: str, stamp: Mapping[str, Column]) -> DataFrame:
    """The new run's rows, and the previous run's rows of keys it hasn't seen, all stamped as the new run."""
    kept = previous.join(current.select(key), key, "left_anti").withColumn("carried", F.lit(True))
    return current.withColumn("carried", F.lit(False)).unionByName(kept).withColumns(dict(stamp))


def pending_runs(runs: DataFrame, processed: DataFrame, order: str, full: str) -> DataFrame:
    """Runs from the latest full one on that aren't processed."""
    since = F.broadcast(runs.where(F.col(full)).agg(F.max(order).alias("_since")))  # one row
    return runs.crossJoin(since).where(F.col(order) >= F.col("_since")).drop("_since").join(processed.select(order), order, "left_anti")


def lower_bound(done: DataFrame, started: str, overlap: str = "1 day") -> DataFrame:
    """Where the next run must begin: the newest start less the overlap."""
    return done.agg((F.max(started) - F.expr(f"interval {overlap}")).alias("bound"))


def not_yet_written(rows: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """What an append-only log lacks; the schemas must agree."""
    if [(f.name, f.dataType) for f in rows.schema] != [(f.name, f.dataType) for f in log.schema]:
        raise ValueError(f"schema changed: {rows.schema.simpleString()} against {log.schema.simpleString()}")
    return rows.dropDuplicates([key]).join(log.select(key), key, "left_anti")


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Append to the Parquet log at ``path`` what it lacks."""
    from pyspark.errors import AnalysisException

    try:
        log = rows.sparkSession.read.parquet(path)
    except AnalysisException as gone:
        if "PATH_NOT_FOUND" not in str(gone):
            raise
        log = rows.where("false")
    not_yet_written(rows, log, key).write.mode("append").parquet(path)
