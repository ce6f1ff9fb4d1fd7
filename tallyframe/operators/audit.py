"""Which records a number is made of: the first exclusion that applies, in a fixed order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decisions(df: DataFrame, exclusions: Sequence[tuple[str, Column]]) -> DataFrame:
    """``decision`` is included or excluded, ``reason`` the first rule that holds; a rule of unknown outcome doesn't exclude."""
    reason = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in exclusions))
    return df.withColumn("reason", reason).withColumn("decision", F.when(F.col("reason").isNull(), "included").otherwise("excluded"))


def summary(decided: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    return decided.groupBy(*by, "decision", "reason").agg(F.countDistinct(key).alias("n"))


def contribution(inside: Column, outside: Column) -> Column:
    """Where a record lies of what a filter asks for."""
    return F.when(inside, "inside").when(outside, "outside").otherwise("undetermined")
