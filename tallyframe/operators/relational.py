"""Filters, joins and aggregates over any tables; columns are arguments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a dealt table that one task gets, about.
ROWS = 500_000


def parts(*tables: DataFrame) -> int:
    """How many parts leave about ROWS rows of the largest table in each; Parquet tables are counted by their footers."""
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, *(-(-t.count() // ROWS) for t in tables))


def dealt_join(a: DataFrame, b: DataFrame, a_key: str, b_key: str, n: int) -> DataFrame:
    """Inner join of two tables that are dealt to ``n`` parts by their keys, so a task's rows, not only its bytes, are bounded.

    Grouping by the key (and more) afterwards needs no other exchange, so its memory is bounded too. Bytes alone don't do that: sorted keys
    and few distinct values shrink to a twentieth in a shuffle. For keys of many values; a key with very many rows is one task's.
    """
    return a.repartition(n, a_key).join(b.repartition(n, b_key), F.col(a_key) == F.col(b_key))


def optional_filter(df: DataFrame, **conditions: tuple[object, Column]) -> DataFrame:
    """Keep rows for which each condition holds whose parameter was given (isn't None)."""
    return reduce(lambda d, c: d.where(c[1]) if c[0] is not None else d, conditions.values(), df)


def member_of(c: Column, wanted: Column, sep: str = "/") -> Column:
    """Equal, or one of the parts of a joined value."""
    return (c == wanted) | F.array_contains(F.split(c, sep), wanted)


def contains_text(c: Column, needle: str) -> Column:
    """Case-insensitive, the needle taken literally."""
    return F.contains(F.lower(c), F.lit(needle.lower()))


def any_key_set(df: DataFrame, key: str, *sets: DataFrame) -> DataFrame:
    """Rows whose key is in one of the sets: OR of EXISTS as one semi-join."""
    keys = reduce(DataFrame.unionByName, [s.select(key) for s in sets])
    return df.join(keys, key, "left_semi")


def in_or_unmapped(df: DataFrame, key: str, wanted: DataFrame, mapped: DataFrame) -> DataFrame:
    """Rows whose key is wanted, or has no mapping at all."""
    return df.join(wanted, key, "left_semi").unionByName(df.join(mapped, key, "left_anti"))


def at_latest(df: DataFrame, date: str) -> DataFrame:
    """Rows of the latest date: the maximum is one row."""
    latest = df.agg(F.max(date).alias(date))
    return df.join(F.broadcast(latest), date, "left_semi")


def null_safe_join(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys whose NULLs are equal; the keys are kept from the left."""
    named = b.select(*(F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in b.columns))
    out = a.join(named, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on)), how)
    return out.drop(*(f"_{c}" for c in on))


def either_key_join(a: DataFrame, b: DataFrame, keys: Sequence[str], b_key: str, row: str) -> DataFrame:
    """Join where any of ``keys`` equals ``b_key``, as one equi-join on the keys laid out; one match per row and key."""
    laid = a.withColumn(b_key, F.explode(F.array_distinct(F.array_compact(F.array(*keys)))))
    return laid.join(b, b_key).dropDuplicates([row, b_key])


#: Hand-written rules that are broadcast at most, about 100 bytes each.
MOST_RULES = 10_000


def counted_rules(rules: DataFrame) -> DataFrame:
    """The rules, if they are few enough to be sent everywhere."""
    if (n := rules.count()) > MOST_RULES:
        raise ValueError(f"{n} rules; at most {MOST_RULES} are sent to every task")
    return rules


def tiered_rules(df: DataFrame, text: str, rules: DataFrame, row: str) -> DataFrame:
    """The best rule of each row: exact terms before substrings, then the rule's order.

    ``rules`` (kind, term, ord, label) is a hand-written table; exact terms are an equi-join, substrings a broadcast of at most MOST_RULES rows.
    """
    counted_rules(rules.where(F.col("kind") == "substring"))
    exact = df.join(rules.where(F.col("kind") == "exact"), F.col(text) == F.col("term")).withColumn("tier", F.lit(0))
    part = F.broadcast(rules.where(F.col("kind") == "substring"))
    loose = df.join(part, F.contains(F.col(text), F.col("term"))).withColumn("tier", F.lit(1))
    best = exact.unionByName(loose).groupBy(row).agg(F.min(F.struct("tier", "ord", "label")).alias("best"))
    return df.join(best, row, "left").select(*df.columns, F.col("best.label").alias("label"), F.col("best.tier").alias("tier"))


def nearest_within(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, days: int) -> DataFrame:
    """For each left row the right row of its key whose date is nearest, at most ``days`` away; ties to the earlier.

    Dates are cut into windows of ``days`` days and the right rows laid into their window and both neighbours, so the
    join is on key and window and a key with very many rows is spread over its windows.
    """
    window = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01")) / days)
    # the answer depends on key and date only
    a = left.select(key, left_date).distinct().withColumn("_w", window(left_date))
    b = right.withColumn("_w", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: window(right_date) + i)))
    gap = F.abs(F.datediff(F.col(right_date), F.col(left_date)))
    found = a.join(b, [key, "_w"]).where(gap <= days)
    rest = [c for c in right.columns if c != key]
    best = found.groupBy(key, left_date).agg(F.min(F.struct(gap.alias("gap"), F.col(right_date).alias("_d"), *(c for c in rest if c != right_date))).alias("m"))
    out = left.join(best, [key, left_date], "left")
    return out.select(*left.columns, F.col("m.gap").alias("gap"), F.col("m._d").alias(right_date), *(F.col(f"m.{c}").alias(c) for c in rest if c != right_date))


def within_miles(a: DataFrame, b: DataFrame, miles: float, distance: Column, cell: float | None = None) -> DataFrame:
    """Pairs of points at most ``miles`` apart: ``a`` (a_lat, a_lon) in grid cells, ``b`` (b_lat, b_lon) laid into the cells
    around each point, so the join is on cells; the exact distance decides. Longitudes are in [-180, 180]; cells go on
    across the date line, and near a pole reach all around it."""
    side = cell or miles / 69.0  # degrees of latitude
    high = miles / 69.0 + 0.01
    cell_of = lambda c: F.floor(c / side)
    top = F.abs(F.col("b_lat")) + high
    reach = F.when(top >= 89.0, 180.0).otherwise(F.least(F.lit(180.0), F.lit(high) / F.cos(F.radians(F.least(top, F.lit(89.0))))))
    cells = a.withColumn("_y", cell_of(F.col("a_lat"))).withColumn("_x", cell_of(F.col("a_lon")))
    near = b.withColumn("_y", F.explode(F.sequence(cell_of(F.col("b_lat") - high), cell_of(F.col("b_lat") + high))))
    # a point stands at its longitude and one turn to either side; only the part within [-180, 180] has cells
    turn = lambda s: F.sequence(cell_of(F.greatest(F.lit(-180.0), F.col("b_lon") + s - reach)), cell_of(F.least(F.lit(180.0), F.col("b_lon") + s + reach)))
    inside = lambda s: (F.col("b_lon") + s + reach >= -180.0) & (F.col("b_lon") + s - reach <= 180.0)
    around = F.concat(*(F.when(inside(s), turn(s)).otherwise(F.array().cast("array<long>")) for s in (-360.0, 0.0, 360.0)))
    near = near.withColumn("_x", F.explode(F.array_distinct(around)))
    return cells.join(near, ["_y", "_x"]).withColumn("miles", distance).where(F.col("miles") <= miles).drop("_y", "_x")


def pairs_by_token(df: DataFrame, key: str, token: str, most: int) -> DataFrame:
    """Pairs of keys that share a token, a < b; tokens of ``most`` or more keys are left out (part of the operator's rules)."""
    rows = df.select(key, token).where(F.col(token).isNotNull()).distinct()
    usable = rows.groupBy(token).agg(F.count("*").alias("n")).where(F.col("n") < most).select(token)
    rows = rows.join(usable, token)
    a, b = rows.select(token, F.col(key).alias("a")), rows.select(token, F.col(key).alias("b"))
    return a.join(b, token).where("a < b").select("a", "b").distinct()


def mirrored(pairs: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.select(F.explode(both).alias("p")).select("p.a", "p.b")


def distinct_where(df: DataFrame, segment: Sequence[str], key: str, flags: Mapping[str, Column]) -> DataFrame:
    """Distinct keys per segment for which each flag holds in some row: grouped twice, so the rows aren't multiplied."""
    per_key = df.groupBy(*segment, key).agg(*(F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()))
    return per_key.groupBy(*segment).agg(*(F.count_if(F.col(n) & F.col(key).isNotNull()).alias(n) for n in flags))


def concentration(df: DataFrame, segment: Sequence[str], owner: str, weight: Column, least: int = 3) -> DataFrame:
    """Sum of squared shares and top share of owners per segment; the index is NULL for fewer than ``least`` owners."""
    per_owner = df.groupBy(*segment, owner).agg(weight.alias("w"))
    share = F.try_divide(F.col("w").cast("double"), F.col("total").cast("double"))
    totals = per_owner.groupBy(*segment).agg(F.sum("w").alias("total"))
    joined = null_safe_join(per_owner, totals, list(segment))
    out = joined.groupBy(*segment).agg(F.count(owner).alias("owners"), F.sum(share * share).alias("h"), F.max(share).alias("top_share"))
    return out.select(*segment, "owners", F.when(F.col("owners") >= least, F.col("h")).alias("hhi"), "top_share")


def strata(df: DataFrame, kinds: Mapping[str, Column], measures: Sequence[Column]) -> DataFrame:
    """The measures by each kind of stratum in one pass: a row is laid out once per kind."""
    laid = F.array(*(F.struct(F.lit(k).alias("stratum_type"), v.cast("string").alias("stratum")) for k, v in kinds.items()))
    return df.withColumn("_s", F.explode(laid)).groupBy(F.col("_s.stratum_type"), F.col("_s.stratum")).agg(*measures)


def weighted_median(df: DataFrame, segment: Sequence[str], value: str, weight: str) -> DataFrame:
    """The least value at which the weights reach half their sum; a NULL value counts as infinite.

    Equal values are summed before the running sum, so a segment's window has one row per distinct value.
    """
    from pyspark.sql import Window

    by_value = df.groupBy(*segment, F.coalesce(F.col(value).cast("double"), F.lit(float("inf"))).alias("_v")).agg(F.sum(weight).alias("_n"))
    ordered = Window.partitionBy(*segment).orderBy("_v")
    run = by_value.withColumn("_upto", F.sum("_n").over(ordered)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*segment)))
    out = run.where(2 * F.col("_upto") >= F.col("_all")).groupBy(*segment).agg(F.min("_v").alias("median"))
    return out.withColumn("median", F.when(F.col("median") != float("inf"), F.col("median")))


def profile(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and each column's share of values that aren't NULL, in one pass; one row per column."""
    row = df.agg(F.count("*").alias("_rows"), F.countDistinct(key).alias("_keys"), *(F.count(c).alias(c) for c in df.columns))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in df.columns)))
    out = row.select("_rows", "_keys", cells.alias("c"))
    return out.select("c.column_name", F.col("_rows").alias("n_rows"), F.col("_keys").alias("n_keys"), F.try_divide(F.col("c.filled").cast("double"), F.col("_rows").cast("double")).alias("filled_share"))


def any_of(*conditions: Column) -> Column:
    return reduce(or_, conditions)
