"""Products of repeated snapshots: current status, changes, activity, competition and trends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import safe_divide
from ..functions.text import surrogate_key
from ..operators.relational import null_safe_join
from ..operators.windows import day_number, latest_per_key, rank_band, trailing, trailing_months


def current_status(history: DataFrame, keys: Sequence[str], date: str, scope: Sequence[str] = ()) -> DataFrame:
    """The latest row per key, and whether it belongs to the scope's latest date."""
    latest = latest_per_key(history, [*scope, *keys], F.col(date).desc())
    newest = history.groupBy(*scope).agg(F.max(date).alias("_newest"))
    joined = null_safe_join(latest, newest, list(scope)) if scope else latest.crossJoin(F.broadcast(newest))  # without scope one row
    return joined.withColumn("is_active_in_latest", F.col(date) == F.col("_newest")).drop("_newest")


def trusted_runs(runs: DataFrame, run: str, date: str, status: str, started: str, retrieved: str, scope: Sequence[str] = ()) -> DataFrame:
    """Successful runs fetched after their own start, each with the trusted run before it."""
    good = runs.where((F.col(status) == "success") & (F.col(retrieved).isNull() | (F.col(retrieved) >= F.col(started))))
    return good.withColumn("previous_run", F.lag(run).over(Window.partitionBy(*scope).orderBy(date, run)))


def change_events(observations: DataFrame, keys: Sequence[str], run: str, previous: DataFrame, fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """One event per field that differs between an observation and that of the run before.

    ``previous`` gives run and previous_run. A field of several columns (a date and its type) changes when any does, and
    its values are the columns joined by '|'. One pass: the changed fields are laid out from an array.
    """
    before = observations.select(*keys, F.col(run).alias("previous_run"), *(F.col(c).alias(f"_old_{c}") for cs in fields.values() for c in cs))
    pairs = observations.join(previous.select(run, "previous_run"), run).join(before, [*keys, "previous_run"])
    shown = lambda cs, p="": F.concat_ws("|", *(F.col(p + c).cast("string") for c in cs))

    def differs(cs: Sequence[str]) -> Column:
        out = F.lit(False)
        for c in cs:
            out = out | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
        return out

    changed = F.array_compact(F.array(*(F.when(differs(cs), F.struct(F.lit(n).alias("field"), shown(cs, "_old_").alias("old_value"), shown(cs).alias("new_value"))) for n, cs in fields.items())))
    rows = pairs.select(*keys, run, "previous_run", F.explode(changed).alias("e"))
    return rows.select(surrogate_key(*(F.col(k) for k in keys), F.col(run), F.col("e.field")).alias("event_key"), *keys, run, "previous_run", "e.field", "e.old_value", "e.new_value")


def competition(activity: DataFrame, calendar: DataFrame, scope: Sequence[str], segment: Sequence[str], key: str, date: str, entered: str, entrant_before: str, days: Sequence[int], growth_days: int, tolerance: int = 7) -> DataFrame:
    """Active keys per segment and date, with trailing entries and growth that are NULL unless the window is covered.

    A window of n days is covered if the scope's history is n days old, its earliest snapshot in the window lies within
    ``tolerance`` days of the window's start, the snapshot before the current one is inside, and so is the one before each
    entry. Growth also needs a baseline at the window's first snapshot, no entries counted in that baseline, and a baseline
    above 0. NULL means unknown; 0 means that none was seen.
    """
    per_key = activity.groupBy(*scope, *segment, date, key).agg(F.bool_or(entered).alias("_in"), F.min(F.when(F.col(entered), F.col(entrant_before))).alias("_before"))
    segments = per_key.groupBy(*scope, *segment, date).agg(F.count(key).alias("active_count"), F.count_if("_in").alias("entered_count"), F.min("_before").alias("_entrant_before"))
    # all windows of one partitioning are asked for at once over a plain day number, so each takes one sort
    days_known = calendar.select(*scope, date).distinct().withColumn("_day", day_number(date))
    days_known = days_known.select(
        *scope, date, F.datediff(date, F.min(date).over(Window.partitionBy(*scope))).alias("history_days"), F.lag(date).over(Window.partitionBy(*scope).orderBy("_day")).alias("_previous"),
        *(F.min(date).over(trailing(scope, date, n, "_day")).alias(f"_first_{n}") for n in days),
    )
    rows = segments.join(days_known, [*scope, date]).withColumn("_day", day_number(date))
    w, g = {n: trailing([*scope, *segment], date, n, "_day") for n in {*days, growth_days}}, growth_days
    rows = rows.select(
        "*", *(F.sum("entered_count").over(w[n]).alias(f"_new_{n}") for n in days), *(F.min("_entrant_before").over(w[n]).alias(f"_entrant_{n}") for n in days),
        F.first("active_count").over(w[g]).alias("_base"), F.first(date).over(w[g]).alias("_base_date"), F.first("entered_count").over(w[g]).alias("_base_in"),
    )
    start = lambda n: F.date_sub(F.col(date), n)
    covered = {
        n: (F.col("history_days") >= n) & (F.col(f"_first_{n}") <= F.date_add(start(n), tolerance)) & (F.col("_previous") >= start(n))
        & (F.col(f"_entrant_{n}").isNull() | (F.col(f"_entrant_{n}") >= start(n)))
        for n in days
    }
    grows = covered[g] & (F.col("_base_date") == F.col(f"_first_{g}")) & ((F.col(f"_new_{g}") == 0) | (F.col("_base_in") == 0)) & (F.col("_base") > 0)
    rank = F.percent_rank().over(Window.partitionBy(*scope, date).orderBy("active_count"))
    out = rows.select(
        *scope, *segment, date, "active_count", "entered_count", "history_days", *(F.when(covered[n], F.col(f"_new_{n}")).alias(f"new_{n}d") for n in days),
        F.when(grows, safe_divide(F.col("active_count") - F.col("_base"), F.col("_base"))).alias(f"growth_{g}d"), rank.alias("density_percentile"),
    )
    return out.withColumn("signal_band", rank_band(F.col("density_percentile")))


def monthly_trends(activity: DataFrame, scope: Sequence[str], segment: Sequence[str], key: str, date: str, population: DataFrame, months: int = 3, least_days: int = 90) -> DataFrame:
    """Distinct keys per segment and month, their trailing mean, growth over the window where it is full, and rate per 100,000.

    Growth needs the window's baseline to be ``months`` months back, and as many days of the scope's history.
    """
    month = F.trunc(date, "month")
    monthly = activity.groupBy(*scope, *segment, month.alias("month")).agg(F.countDistinct(key).alias("n"))
    seen = activity.groupBy(*scope, month.alias("month")).agg(F.min(date).alias("_low"), F.max(date).alias("_high"))
    run = Window.partitionBy(*scope).orderBy("month")
    seen = seen.select(*scope, "month", F.datediff(F.max("_high").over(run), F.min("_low").over(run)).alias("_days"))
    w = trailing_months([*scope, *segment], "month", months)
    rows = monthly.join(seen, [*scope, "month"]).select("*", F.avg("n").over(w).alias("trailing_avg"), F.first("n").over(w).alias("_base"), F.min("month").over(w).alias("_base_month"))
    full = (F.col("_days") >= least_days) & (F.col("_base_month") <= F.add_months("month", -months))
    joined = rows.join(population, [c for c in population.columns if c != "population"], "left")
    return joined.select(*scope, *segment, "month", "n", "trailing_avg", F.when(full, safe_divide(F.col("n") - F.col("_base"), F.col("_base"))).alias("growth"), F.round(safe_divide(F.col("n"), F.col("population")) * 100_000, 4).alias("per_100k"))
