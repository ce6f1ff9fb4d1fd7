"""Access by distance, rates, participation and transparency products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import haversine_miles, safe_divide, wilson
from ..operators.relational import parts as parts_of
from ..operators.relational import within_miles
from ..operators.stages import written


#: Pairs of a site and a near area that are sent to every task at most, about 50 bytes each.
MOST_NEAR = 500_000


def by_area(sites: DataFrame, areas: DataFrame, nodes: DataFrame, miles: Sequence[float], places: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """For every node and area: nearest distance and distinct keys within each radius, 0 where there is none.

    ``sites`` (node, key, site, a_lat, a_lon), ``areas`` (area, b_lat, b_lon; a fixed list of places), ``nodes`` (node).
    The distance is computed once per distinct site and area. Where ``places`` (site, a_lat, a_lon) are given, sites need no coordinates. Sites are
    dealt by their keys to ``parts`` parts, in which their areas are found and grouped, so a task's rows are bounded.
    """
    points = (sites if places is None else places).select("site", "a_lat", "a_lon").where("a_lat is not null and a_lon is not null").distinct()
    near = within_miles(points, areas, max(miles), haversine_miles(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))).select("site", "area", "miles")
    near = written(near, "near-areas")
    pairs, each = near.count(), max(1, points.count())
    listed = sites.select("node", "key", "site").join(F.broadcast(near) if pairs <= MOST_NEAR else near, "site")
    dealt = listed.repartition((parts or parts_of(sites)) * max(1, -(-pairs // each)), "key")  # a site has this many areas on average
    best = dealt.groupBy("node", "area", "key").agg(F.min("miles").alias("miles"))
    found = best.groupBy("node", "area").agg(F.min("miles").alias("nearest_miles"), *(F.count_if(F.col("miles") <= m).alias(f"within_{m:g}") for m in miles))
    grid = nodes.select("node").crossJoin(areas.select("area"))  # both are fixed lists; every pair is wanted
    tier = F.lit(None).cast("string")
    for m in sorted(miles, reverse=True):
        tier = F.when(F.col("nearest_miles") <= m, f"within_{m:g}").otherwise(tier)
    out = grid.join(found, ["node", "area"], "left").withColumn("tier", F.coalesce(tier, F.lit("none")))
    return out.select("node", "area", "nearest_miles", *(F.coalesce(f"within_{m:g}", F.lit(0)).alias(f"within_{m:g}") for m in miles), "tier")


def overlap_hotspots(sites: DataFrame, place: Sequence[str], key: str, kind: str, least: int = 2) -> DataFrame:
    """Places with several keys, with the mix of their kinds."""
    per = sites.groupBy(*place).agg(F.countDistinct(key).alias("n_keys"), F.sort_array(F.collect_set(kind)).alias("_kinds"))
    return per.where(F.col("n_keys") >= least).select(*place, "n_keys", F.array_join("_kinds", ", ").alias("mix"))


def area_rates(counts: DataFrame, population: DataFrame, burden: DataFrame, area: str, confirmed: Column) -> DataFrame:
    """Keys per 100,000 residents, and per 1,000 cases only where the burden is confirmed."""
    joined = counts.join(population, area, "left").join(burden, area, "left")
    return joined.select(
        *counts.columns, F.round(safe_divide(F.col("n"), F.col("population")) * 100_000, 4).alias("per_100k"),
        F.when(confirmed, F.round(safe_divide(F.col("n"), F.col("cases")) * 1000, 4)).alias("per_1k_cases"), F.coalesce(confirmed, F.lit(False)).alias("denominator_available"),
    )


def participation_ratio(counts: DataFrame, reference: DataFrame, dimension: Sequence[str], label: str, suppress: int = 3, low: int = 5) -> DataFrame:
    """Share of participants over reference share, with Wilson bounds; NULL for fewer than ``suppress`` records.

    ``counts`` (dimension, label, n, records), ``reference`` (dimension, label, reference_share).
    """
    total = counts.groupBy(*dimension).agg(F.sum("n").alias("total"))
    rows = counts.join(total, list(dimension)).join(reference, [*dimension, label], "left")
    lower, upper = wilson(F.col("n"), F.col("total"))
    shown = F.col("records") >= suppress
    over = lambda c: F.when(shown, F.round(safe_divide(c, F.col("reference_share")), 6))
    return rows.select(
        *dimension, label, "n", "records", over(safe_divide(F.col("n"), F.col("total"))).alias("ratio"), over(lower).alias("ratio_low"), over(upper).alias("ratio_high"),
        (~shown).alias("suppressed"), (shown & (F.col("records") < low)).alias("low_n"),
    )


def stopped_summary(rows: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Count and sorted list of the keys of each class, reasons verbatim."""
    return rows.groupBy(*by).agg(F.countDistinct(key).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_set(key)), lambda k: k.cast("string")), ", ").alias("ids"))


def posting_transparency(rows: DataFrame, by: Sequence[str], key: str, evaluable: Column, posted: Column, least: int = 5) -> DataFrame:
    """Share of evaluable keys that are posted, with Wilson bounds, ranked among classes with at least ``least``."""
    per_key = rows.groupBy(*by, key).agg(F.bool_or(evaluable).alias("e"), F.bool_or(evaluable & posted).alias("p"))
    per = per_key.groupBy(*by).agg(F.count_if("e").alias("evaluable"), F.count_if("p").alias("posted"))
    lower, upper = wilson(F.col("posted"), F.col("evaluable"))
    share = safe_divide(F.col("posted"), F.col("evaluable"))
    enough = F.col("evaluable") >= least
    ranked = F.rank().over(Window.partitionBy(enough).orderBy(F.col("share").desc_nulls_last()))  # one row per class
    out = per.select(*by, "evaluable", "posted", share.alias("share"), lower.alias("low"), upper.alias("high"))
    return out.withColumn("rank", F.when(enough, ranked))
