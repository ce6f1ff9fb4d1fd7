"""Histories as validity intervals: one row for each run of equal states, however many snapshots saw it.

``valid_from`` is the first day of the run, ``valid_to`` the first day on which it holds no longer, NULL while it holds. A key that a
snapshot lacks ends on that snapshot's day.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of one bucket of the interval join.
BUCKET = 64


def build_intervals(history: DataFrame, keys: Sequence[str], date: str, state: Sequence[str], days: DataFrame | None = None) -> DataFrame:
    """Keys, state, ``valid_from`` and ``valid_to`` of a history with one row per key and snapshot day.

    ``days``: a table of all snapshot days (column ``date``), if some held no row at all of these keys; else the history's own.
    """
    calendar = (history if days is None else days).select(date).distinct()
    # one row per snapshot day, whatever the number of keys
    calendar = calendar.withColumn("_next", F.lead(date).over(Window.orderBy(date)))
    over = Window.partitionBy(*keys).orderBy(date)
    same = reduce(and_, (F.col(c).eqNullSafe(F.lag(c).over(over)) for c in state), F.lag("_next").over(over).eqNullSafe(F.col(date)))
    rows = history.join(F.broadcast(calendar), date).withColumn("_new", F.when(same, 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(over))
    return rows.groupBy(*keys, "_run").agg(*(F.first(c).alias(c) for c in state), F.min(date).alias("valid_from"), F.max(F.struct(F.col(date), F.col("_next"))).alias("_end")).select(
        *keys, *state, "valid_from", F.col("_end._next").alias("valid_to")
    )


def as_of(intervals: DataFrame, day: Column) -> DataFrame:
    """The states that held on a day, as the snapshot of that day (or the last before it) had them."""
    return intervals.where((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") > day)))


def with_snapshot(intervals: DataFrame, snapshot: DataFrame, day: Column, keys: Sequence[str], state: Sequence[str]) -> DataFrame:
    """``intervals`` after one more snapshot (one row per key): what it leaves as it was keeps its row, so a snapshot that changes nothing adds none.

    ``day`` must be after every day seen so far. Only open intervals meet the snapshot.
    """
    closed, open_ = intervals.where("valid_to IS NOT NULL"), intervals.where("valid_to IS NULL")
    now = snapshot.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), *(F.col(c).alias(f"_s{i}") for i, c in enumerate(state)), F.lit(True).alias("_there"))
    both = open_.withColumn("_was", F.lit(True)).join(now, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys))), "full")
    equal = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(state)), F.col("_was") & F.col("_there"))
    kept = F.struct(*keys, *state, "valid_from", F.when(~F.coalesce(equal, F.lit(False)), day).alias("valid_to"))
    fresh = F.struct(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keys)), *(F.col(f"_s{i}").alias(c) for i, c in enumerate(state)), day.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    rows = F.array_compact(F.array(F.when(F.col("_was"), kept), F.when(F.col("_there") & ~F.coalesce(equal, F.lit(False)), fresh)))
    return closed.unionByName(both.select(F.explode(rows).alias("r")).select("r.*"))


def at_their_days(points: DataFrame, intervals: DataFrame, keys: Sequence[str], day: str, until: Column) -> DataFrame:
    """``points`` joined with the interval of their keys that holds on their ``day``.

    Days are cut into buckets of BUCKET days and an interval is laid into those it touches (an open one up to ``until``, which must not be
    before any point's day), so the join is on keys and bucket: a key with a long history is spread over its buckets.
    """
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / BUCKET)
    last = F.coalesce(F.date_sub("valid_to", 1), until)
    laid = intervals.where(F.col("valid_from") <= last).withColumn("_b", F.explode(F.sequence(bucket(F.col("valid_from")), bucket(last))))
    found = points.withColumn("_b", bucket(F.col(day))).join(laid, [*keys, "_b"])
    return found.where((F.col("valid_from") <= F.col(day)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col(day)))).drop("_b")
