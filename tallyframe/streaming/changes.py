"""The incremental steps on streams: change events against the last known state, and page ingest with quarantine."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import surrogate_key
from ..sources.pages import screen


#: Batches from one whole state to the next.
COMPACT = 20


def _read(spark: SparkSession, path: str, schema, first: bool = False) -> DataFrame:
    """A part of the state; only the one before the ``first`` batch may not be there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as gone:
        if "PATH_NOT_FOUND" not in str(gone):
            raise
        if not first:
            raise FileNotFoundError(f"the state at {path} is gone; without it every key would seem new") from gone
        return spark.createDataFrame([], schema)


def batch_changes(batch: DataFrame, state: DataFrame, keys: Sequence[str], at: str, status: str) -> DataFrame:
    """Every observation of a batch with the status before it: within the batch, else the stored one.

    ``late`` marks observations that aren't after the stored state; they change nothing.
    """
    over = Window.partitionBy(*keys).orderBy(at)
    known = state.select(*keys, F.col(at).alias("_state_at"), F.col(status).alias("_state"))
    # of several statuses at one time the greatest counts, whatever order they come in
    rows = batch.groupBy(*keys, at).agg(F.max(status).alias(status)).select(*batch.columns).join(known, list(keys), "left").withColumn("late", F.coalesce(F.col(at) <= F.col("_state_at"), F.lit(False)))
    fresh = rows.where(~F.col("late")).withColumn("_seen", F.lag(at).over(over)).withColumn("previous", F.when(F.col("_seen").isNull(), F.col("_state")).otherwise(F.lag(status).over(over)))
    fresh = fresh.withColumn("changed", (F.col("_seen").isNotNull() | F.col("_state_at").isNotNull()) & ~F.col(status).eqNullSafe(F.col("previous")))
    late = rows.where("late").withColumn("previous", F.lit(None).cast(rows.schema[status].dataType)).withColumn("changed", F.lit(False))
    return fresh.drop("_seen").unionByName(late).withColumn("event_key", surrogate_key(*(F.col(k) for k in keys), F.col(at), F.lit(status))).drop("_state", "_state_at")


def state_before(spark: SparkSession, root: str, number: int, keys: Sequence[str], at: str, schema, since: int | None = None) -> DataFrame:
    """The newest observation of each key before a batch: the last whole state (before batch ``since``), and what the batches since then changed."""
    known = number if since is None else since
    whole = known - 1 - (known % COMPACT)  # -1 before the first
    parts = [_read(spark, f"{root}/state/whole={whole}", schema, whole < 0), *(_read(spark, f"{root}/state/batch={n}", schema) for n in range(whole + 1, number))]
    rest = [f.name for f in schema if f.name not in keys]
    every = reduce(DataFrame.unionByName, parts)
    newest = every.groupBy(*keys).agg(F.max(F.struct(at, *(c for c in rest if c != at))).alias("m"))
    return newest.select(*(F.col(c) if c in keys else F.col(f"m.{c}").alias(c) for c in (f.name for f in schema)))


def change_stream(stream: DataFrame, root: str, keys: Sequence[str], at: str, status: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write change events, late rows and the changed part of the state under ``root`` for each micro-batch.

    A batch writes the state of its own keys only; every COMPACT batches the whole state is written anew. Each batch has
    its own folders and is replaced as a whole if it is run again after a failure; it reads those before it only, so a
    repeated batch sees the state that it saw first.
    """
    wanted = [*keys, at, status]

    def write(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, batch.select(*wanted)
        state = state_before(spark, root, number, keys, at, rows.schema)
        found = batch_changes(rows, state, keys, at, status).persist()
        try:
            found.where("changed").select("event_key", *wanted, "previous").write.mode("overwrite").parquet(f"{root}/changes/batch={number}")
            found.where("late").select(*wanted).write.mode("overwrite").parquet(f"{root}/late/batch={number}")
            newest = found.where("not late").groupBy(*keys).agg(F.max(F.struct(at, status)).alias("m")).select(*keys, f"m.{at}", f"m.{status}")
            newest.write.mode("overwrite").parquet(f"{root}/state/batch={number}")
            if (number + 1) % COMPACT == 0:
                state_before(spark, root, number + 1, keys, at, rows.schema, number).write.mode("overwrite").parquet(f"{root}/state/whole={number}")
        finally:
            found.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest_stream(pages: DataFrame, root: str, is_object: Column, key: Column, pattern: str, checkpoint: str) -> StreamingQuery:
    """Good records and quarantine of each micro-batch to their own tables, one pass over the batch."""

    def write(batch: DataFrame, number: int) -> None:
        screened = screen(batch, is_object, key, pattern).persist()
        try:
            screened.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{root}/good/batch={number}")
            screened.where("reason is not null").write.mode("overwrite").parquet(f"{root}/quarantine/batch={number}")
        finally:
            screened.unpersist()

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, by: str, late: str, width: str) -> DataFrame:
    """Counts per tumbling window, rows later than the watermark left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))
