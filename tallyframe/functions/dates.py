"""Partial dates, calendar parts and spans as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_partial_date(c: Column) -> Column:
    """yyyy-MM-dd, yyyy-MM or yyyy to a date, missing parts being 1; anything else NULL."""
    full = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c).when(c.rlike(r"^\d{4}-\d{2}$"), F.concat(c, F.lit("-01"))).when(c.rlike(r"^\d{4}$"), F.concat(c, F.lit("-01-01")))
    return full.try_cast("date")


def date_precision(c: Column) -> Column:
    known = parse_partial_date(c).isNotNull()
    return (
        F.when(c.isNull() | (F.trim(c) == ""), "missing").when(known & (F.length(c) == 10), "day").when(known & (F.length(c) == 7), "month")
        .when(known, "year").otherwise("unparseable")
    )


def month_diff(later: Column, earlier: Column) -> Column:
    """Calendar months crossed, not months elapsed."""
    return (F.year(later) * 12 + F.month(later)) - (F.year(earlier) * 12 + F.month(earlier))


def five_year_bucket(c: Column) -> Column:
    return (F.floor(F.year(c) / 5) * 5).cast("int")


def utc_timestamp(c: Column) -> Column:
    return c.try_cast("timestamp")


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 3.6e9


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per day with its parts."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return days.select(
        "day", F.year("day").alias("year"), F.quarter("day").alias("quarter"), F.month("day").alias("month"), F.date_format("day", "yyyy-MM").alias("year_month"),
        F.trunc("day", "month").alias("month_start"), F.trunc("day", "quarter").alias("quarter_start"), F.date_format("day", "EEEE").alias("day_name"), (F.weekday("day") >= 5).alias("is_weekend"),
    )
