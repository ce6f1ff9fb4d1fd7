"""Dimensions, bridges and facts: one function per product, tables and columns as arguments.

``scope`` are the columns that tell independent populations apart (a profile, a preset, or none at registry grain).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import normalize_text, surrogate_key
from ..operators.relational import distinct_where
from ..operators.windows import latest_per_key


def build_geography(listings: DataFrame, keys: Sequence[str], place: Sequence[str], usable: Column) -> DataFrame:
    """Distinct usable listings: one row per key and place."""
    return listings.where(usable).select(*keys, *place).distinct()


def build_site_activity(history: DataFrame, sites: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Every observation of the history with each of its sites; observations without a site drop out."""
    return history.join(sites, list(on)).select(*columns).distinct()


def build_site_fact(sites: DataFrame, grain: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    """One row per record, facility, city, state and date (``grain``): the newest by ``newest``."""
    return latest_per_key(sites, list(grain), *newest)


def build_record_dimension(history: DataFrame, keys: Sequence[str], date: str, extracted: Column, flags: Mapping[str, Column], present: Column) -> DataFrame:
    """The current row of each record with named flags, and ``has_terms``: whether the record has derived terms, NULL where none were ever extracted for its run."""
    current = latest_per_key(history, list(keys), F.col(date).desc())
    return current.withColumns({"has_terms": F.when(extracted, present), **flags})


def group_node(label: Column) -> Column:
    """The node of a condition group: ``group:`` and the label's slug."""
    return F.concat(F.lit("group:"), F.replace(normalize_text(label), F.lit(" "), F.lit("-")))


def build_condition_bridge(rows: DataFrame, keys: Sequence[str], group: Column, term: Column, is_ancestor: Column) -> DataFrame:
    """Record to node: its groups and its terms in one pass, the terms of the closure flagged."""
    nodes = F.array(F.struct(group_node(group).alias("node"), F.lit(False).alias("is_ancestor")), F.struct(term.alias("node"), is_ancestor.alias("is_ancestor")))
    return rows.select(*keys, F.explode(nodes).alias("n")).select(*keys, "n.node", "n.is_ancestor").where("node IS NOT NULL")


def build_condition_dimension(bridge: DataFrame, key: str) -> DataFrame:
    """Nodes with their number of records; a node is ancestor only if all of its edges are."""
    return bridge.groupBy("node").agg(F.countDistinct(key).alias("n"), F.every("is_ancestor").alias("is_ancestor_only"))


def build_sponsor_dimension(rows: DataFrame, segment: Sequence[str], owner: str, lead: Column, names: tuple[str, str] = ("owners", "leads")) -> DataFrame:
    """Distinct owners per segment, and those that lead somewhere."""
    return distinct_where(rows, list(segment), owner, {names[0]: F.lit(True), names[1]: lead})


def build_geography_dimension(rows: DataFrame, segment: Sequence[str], key: str, name: str) -> DataFrame:
    """Distinct records per place, of all retained listings."""
    return distinct_where(rows, list(segment), key, {name: F.lit(True)})


def build_population_dimension(population: DataFrame, areas: DataFrame, area: str, code: str, name: str, value: Column) -> DataFrame:
    """Population by area with the area's name where it has one."""
    named = areas.select(F.col(code).alias("_code"), name)
    return population.join(named, F.col(area) == F.col("_code"), "left").groupBy(F.col(area).alias("state"), name).agg(value.alias("population"))


def build_date_dimension(days: DataFrame, day: str) -> DataFrame:
    """Calendar parts of each distinct day: a fact table's days, or those of a spine."""
    d = F.col("date_day")
    return days.select(F.col(day).cast("date").alias("date_day")).where(d.isNotNull()).distinct().select(
        d, F.year(d).cast("long").alias("year"), F.quarter(d).cast("long").alias("quarter"), F.month(d).cast("long").alias("month"), F.date_format(d, "yyyy-MM").alias("year_month"),
        F.trunc(d, "month").alias("month_start"), F.trunc(d, "quarter").alias("quarter_start"), F.date_format(d, "EEEE").alias("day_name"), (F.weekday(d) >= 5).alias("is_weekend"),
    )


def build_sponsor_bridge(rows: DataFrame, key: str, owner: str, role: Column) -> DataFrame:
    return rows.select(key, owner, role.alias("role")).distinct()


def build_membership(records: DataFrame, key: str, term: Column, presets: DataFrame) -> DataFrame:
    """Preset to record by equal terms (case and outer blanks aside); records in no preset are ``unassigned``.

    ``presets`` (preset, term) is a table of the presets' terms.
    """
    clean = lambda c: F.lower(F.trim(c))
    wanted = presets.select("preset", clean(F.col("term")).alias("_term")).distinct()
    found = records.select(key, clean(term).alias("_term")).join(wanted, "_term").select("preset", key).distinct()
    return found.unionByName(records.select(key).distinct().join(found, key, "left_anti").select(F.lit("unassigned").alias("preset"), key))


def build_snapshot_fact(history: DataFrame, keys: Sequence[str], date: str, counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """History with the counts of each observation (zero where there are none), a surrogate key and the current flag."""
    grain = [*keys, date]
    numbers = [c for c in counts.columns if c not in grain]
    rows = history.join(counts, grain, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})
    current = F.col(date) == F.max(date).over(Window.partitionBy(*keys))
    return rows.select(surrogate_key(*(F.col(c) for c in grain)).alias("fact_key"), *grain, *columns, *numbers, current.alias("is_current"))


def build_outcome_sets(outcomes: DataFrame, keys: Sequence[str], order: Sequence[str], text: Column) -> DataFrame:
    """``set_hash`` of each key's rows in order; the same rows in the same order give the same hash."""
    rows = F.sort_array(F.collect_list(F.struct(*order, text.alias("_text"))))
    return outcomes.groupBy(*keys).agg(F.md5(F.array_join(F.transform(rows, lambda r: r["_text"]), "##")).alias("set_hash"))


def build_outcome_changes(sets: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Observations whose set differs from that of the observation before."""
    before = F.lag("set_hash").over(Window.partitionBy(*keys).orderBy(date))
    return sets.withColumn("previous_hash", before).where("previous_hash IS NOT NULL AND previous_hash <> set_hash")


def build_comparability(records: DataFrame, related: DataFrame, key: str, lists: Mapping[str, str], numbers: Mapping[str, str], band: Column) -> DataFrame:
    """Each record with sorted lists of distinct related values, distinct counts (zero without any) and its size band."""
    per = related.groupBy(key).agg(
        *(F.sort_array(F.collect_set(c)).alias(n) for n, c in lists.items()), *(F.countDistinct(c).alias(n) for n, c in numbers.items())
    )
    return records.join(per, key, "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in numbers} | {"band": band})


def build_spine(spark, first: str, last: Column) -> DataFrame:
    """One row per day of the calendar."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), last, F.expr("interval 1 day"))).alias("date_day"))


def build_date_audit(rows: DataFrame, text: Column, exclusion: Column, since: str) -> DataFrame:
    """Rows by precision of a partial date and reason of exclusion, with the largest distance in calendar months from ``since``."""
    months = dates.month_diff(F.lit(since).cast("date"), dates.parse_partial_date(text))
    return rows.groupBy(dates.date_precision(text).alias("precision"), exclusion.alias("exclusion_reason")).agg(F.count("*").alias("n"), F.max(months).cast("long").alias("oldest_months"))


def build_location_audit(listings: DataFrame, areas: DataFrame, area: str, code: str, columns: Sequence[str], suspicious: Column) -> DataFrame:
    """Listings with their area's name where it is known, and whether the listing is suspicious."""
    return listings.join(areas.withColumnRenamed(code, "_code"), F.col(area) == F.col("_code"), "left").select(*columns, suspicious.alias("suspicious"))
