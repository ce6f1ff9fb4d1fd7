"""Windows over histories: latest rows, transitions, trailing sums with coverage, forward fill, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")


def beyond_newest(df: DataFrame, scope: Sequence[str], run: str, keep: int) -> DataFrame:
    """Rows older than the newest ``keep`` of their scope."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*scope).orderBy(F.col(run).desc())))
    return ranked.where(F.col("_rn") > keep).drop("_rn")


def status_history(observations: DataFrame, keys: Sequence[str], date: str, status: str, active: str) -> DataFrame:
    """Transitions of one status per key and date: previous status and date, changed, entered and left ``active``,
    first seen and days since. One row per key and date is expected."""
    over = Window.partitionBy(*keys).orderBy(date)
    before = F.lag(status).over(over)
    out = observations.withColumn("previous_status", before).withColumn("previous_date", F.lag(date).over(over)).withColumn("first_seen", F.min(date).over(Window.partitionBy(*keys)))
    seen = F.col("previous_date").isNotNull()
    return out.select(
        *observations.columns, "previous_status", "previous_date",
        (seen & ~F.col(status).eqNullSafe(F.col("previous_status"))).alias("changed"),
        (seen & (F.col(status) == active) & ~F.col("previous_status").eqNullSafe(F.lit(active))).alias("entered"),
        (seen & ~F.col(status).eqNullSafe(F.lit(active)) & (F.col("previous_status") == active)).alias("left"),
        "first_seen", F.datediff(date, "first_seen").alias("days_since_first"),
    )


def day_number(date: str) -> Column:
    return F.datediff(F.col(date), F.lit("1970-01-01"))


def trailing(keys: Sequence[str], date: str, days: int, number: str | None = None):
    """The window of the ``days`` days up to the row's date.

    ``number`` names a column that holds ``day_number(date)``: windows over it share one sort, whatever their length.
    """
    day = F.col(number) if number else day_number(date)
    return Window.partitionBy(*keys).orderBy(day).rangeBetween(-days, Window.currentRow)


def trailing_months(keys: Sequence[str], month: str, months: int):
    """The window of the ``months`` months up to the row's month."""
    number = F.year(month) * 12 + F.month(month)
    return Window.partitionBy(*keys).orderBy(number).rangeBetween(-months, Window.currentRow)


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, out: str) -> DataFrame:
    over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.last(column, ignorenulls=True).over(over))


def rank_band(rank: Column, limits: tuple[float, float] = (0.5, 0.8), names: tuple[str, str, str] = ("low", "moderate", "elevated")) -> Column:
    return F.when(rank < limits[0], names[0]).when(rank < limits[1], names[1]).otherwise(names[2])
