"""Checks: each returns the rows that violate it, or one row that tells whether it holds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(name: str, df: DataFrame, bad: Column, key: Column) -> DataFrame:
    return df.where(bad).select(F.lit(name).alias("check"), key.cast("string").alias("item"))


def not_null(df: DataFrame, column: str, key: str) -> DataFrame:
    return violations(f"not_null_{column}", df, F.col(column).isNull(), F.col(key))


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once at their grain."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return repeated.select(F.lit("unique_" + "_".join(keys)).alias("check"), F.concat_ws("|", *keys).alias("item"))


def accepted(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    others = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values)).select(column).distinct()
    return others.select(F.lit(f"accepted_{column}").alias("check"), F.col(column).cast("string").alias("item"))


def related(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child keys that have no parent."""
    orphans = child.where(F.col(column).isNotNull()).select(F.col(column).alias(key)).distinct().join(parent.select(key), key, "left_anti")
    return orphans.select(F.lit(f"related_{column}").alias("check"), F.col(key).cast("string").alias("item"))


def dense_ranks(df: DataFrame, key: str, rank: str) -> DataFrame:
    """Keys whose ranks aren't 1 to n without gaps."""
    per = df.groupBy(key).agg(F.min(rank).alias("a"), F.max(rank).alias("z"), F.count("*").alias("n"), F.countDistinct(rank).alias("d"))
    return violations(f"dense_{rank}", per, (F.col("a") != 1) | (F.col("z") != F.col("n")) | (F.col("d") != F.col("n")), F.col(key))


def equal_totals(name: str, a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose totals differ between two relations, either side possibly absent."""
    x, y = a.groupBy(key).agg(F.sum(value).alias("x")), b.groupBy(key).agg(F.sum(value).alias("y"))
    return violations(name, x.join(y, key, "full"), ~F.col("x").eqNullSafe(F.col("y")), F.col(key))


def nested(df: DataFrame, key: Column, *columns: str) -> DataFrame:
    """Rows in which a smaller radius counts more than a larger one."""
    bad = reduce(lambda s, p: s | (F.col(p[0]) > F.col(p[1])), zip(columns, columns[1:], strict=False), F.lit(False))
    return violations("nested_" + "_".join(columns), df, bad, key)


def bounded(df: DataFrame, column: str, low: float, high: float, keys: Sequence[str]) -> DataFrame:
    """Rows whose value is outside its bounds."""
    return _at_grain(f"bounded_{column}", df, ~F.col(column).between(low, high), keys)


def no_self_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Records that are paired with themselves."""
    return violations(f"self_pair_{a}_{b}", df, F.col(a) == F.col(b), F.col(a))


def enough_owners(df: DataFrame, index: str, owners: str, keys: Sequence[str], least: int = 3) -> DataFrame:
    """Segments that give a concentration with too few owners, or none with enough."""
    return _at_grain(f"owners_{index}", df, F.col(index).isNotNull() != (F.col(owners) >= least), keys)


def explained(df: DataFrame, counts: str, reason: str, key: Column) -> DataFrame:
    """Rows that count and name a reason against it, or do neither."""
    return violations(f"explained_{counts}", df, F.col(counts).eqNullSafe(F.lit(True)) != F.col(reason).isNull(), key)


def unchanged_by_join(name: str, before: DataFrame, after: DataFrame, scope: str, value: str) -> DataFrame:
    """Scopes whose total a join has changed, as one does that multiplies or loses the rows of a study."""
    return equal_totals(name, before, after, scope, value)


def parts_of_whole(name: str, strata: DataFrame, kind: str, value: str, whole: DataFrame) -> DataFrame:
    """Kinds of strata whose parts don't add up to the one row of the whole (its column of the same name)."""
    total = whole.select(F.col(value).alias("_all"))
    per = strata.groupBy(kind).agg(F.sum(value).alias("_sum")).crossJoin(F.broadcast(total))  # the whole is one row
    return violations(name, per, ~F.col("_sum").eqNullSafe(F.col("_all")), F.col(kind))


def members_hold(name: str, members: DataFrame, key: str, expected: DataFrame, scope: str) -> DataFrame:
    """Memberships (scope, key) on one side only, with the scope before the key."""
    a, b = members.select(scope, key).distinct(), expected.select(scope, key).distinct()
    odd = a.join(b, [scope, key], "left_anti").unionByName(b.join(a, [scope, key], "left_anti"))
    return odd.select(F.lit(name).alias("check"), F.concat_ws("|", scope, key).alias("item"))


def _at_grain(name: str, df: DataFrame, bad: Column, keys: Sequence[str]) -> DataFrame:
    return violations(name, df, bad, F.concat_ws("|", *keys))


def uncovered_windows(name: str, rows: DataFrame, value: str, calendar: DataFrame, entries: DataFrame, scope: Sequence[str], segment: Sequence[str], date: str, before: str, days: int, tolerance: int = 7) -> DataFrame:
    """Rows that give ``value`` though a guard of the window of ``days`` days fails.

    The guards are found anew by joins, where the product uses windows: ``calendar`` (scope, date) has the scope's snapshots,
    ``entries`` (scope, segment, date, ``before``) the entries with the snapshot before each. Work grows with the days of a
    scope squared, and with the entries of a window.
    """
    given, start = rows.where(F.col(value).isNotNull()).select(*scope, *segment, date).distinct(), F.date_sub(F.col(date), days)
    known = given.select(*scope, date).distinct().join(calendar.select(*scope, F.col(date).alias("_at")).distinct(), list(scope)).where(F.col("_at") <= F.col(date))
    known = known.groupBy(*scope, date).agg(
        F.min("_at").alias("_oldest"), F.min(F.when(F.col("_at") >= start, F.col("_at"))).alias("_first"), F.max(F.when(F.col("_at") < F.col(date), F.col("_at"))).alias("_previous"),
    )
    inside = given.join(entries.select(*scope, *segment, F.col(date).alias("_at"), F.col(before).alias("_before")), [*scope, *segment]).where(F.col("_at").between(start, F.col(date)))
    entrant = inside.groupBy(*scope, *segment, date).agg(F.min("_before").alias("_before"))
    whole = given.join(known, [*scope, date], "left").join(entrant, [*scope, *segment, date], "left")
    covered = (F.datediff(date, "_oldest") >= days) & (F.col("_first") <= F.date_add(start, tolerance)) & (F.col("_previous") >= start) & (F.col("_before").isNull() | (F.col("_before") >= start))
    return _at_grain(name, whole, ~F.coalesce(covered, F.lit(False)), [*scope, *segment, date])


def ungrounded_growth(name: str, rows: DataFrame, value: str, activity: DataFrame, scope: Sequence[str], segment: Sequence[str], date: str, months: int = 3, least_days: int = 90) -> DataFrame:
    """Monthly rows that give ``value`` though their segment has no row ``months`` months back or the scope's history is too short.

    Found by joins, where the product uses windows; the months of a scope meet each other.
    """
    given = rows.where(F.col(value).isNotNull()).select(*scope, *segment, "month").distinct()
    seen = activity.groupBy(*scope, F.trunc(date, "month").alias("_month")).agg(F.min(date).alias("_low"), F.max(date).alias("_high"))
    known = given.select(*scope, "month").distinct().join(seen, list(scope)).where(F.col("_month") <= F.col("month"))
    known = known.groupBy(*scope, "month").agg(F.datediff(F.max("_high"), F.min("_low")).alias("_days"))
    base = rows.select(*scope, *segment, F.add_months("month", months).alias("month"), F.lit(True).alias("_base")).distinct()
    whole = given.join(known, [*scope, "month"], "left").join(base, [*scope, *segment, "month"], "left")
    grounded = F.col("_base") & (F.col("_days") >= least_days)
    return _at_grain(name, whole, ~F.coalesce(grounded, F.lit(False)), [*scope, *segment, "month"])


def together(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def reconciled(name: str, expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row (check, expected, actual, passed) from two one-row counts."""
    both = expected.select(F.col(expected.columns[0]).alias("expected")).crossJoin(F.broadcast(actual.select(F.col(actual.columns[0]).alias("actual"))))
    return both.select(F.lit(name).alias("check"), "expected", "actual", F.col("expected").eqNullSafe(F.col("actual")).alias("passed"))


def drift(observed: DataFrame, baseline: DataFrame, path: str) -> DataFrame:
    """Paths that appeared or went."""
    o, b = observed.select(path).distinct(), baseline.select(path).distinct()
    return o.join(b, path, "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(o, path, "left_anti").withColumn("change", F.lit("removed")))


def guarded_rebuild(new: DataFrame, old: DataFrame) -> None:
    """Refuse to replace an output by one with fewer rows."""
    n, m = new.count(), old.count()
    if n < m:
        raise ValueError(f"the rebuild has {n} rows, what it would replace has {m}")
