"""Search and detail over the registry's staged tables: every filter, the nearest open site of each record, pages by key.

A filter that isn't given keeps everything. What other tables must hold (a sponsor's class, an intervention's type, a condition's text or
term) are semi-joins on keys, so no record is multiplied and nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import haversine_miles
from ..operators.relational import any_key_set, contains_text, member_of

# Statuses of a site that takes people, and the sort modes with their column and direction.
OPEN_SITES = ("RECRUITING", "NOT_YET_RECRUITING")
SORTS = {
    "updated": ("last_update_post_date", True), "-updated": ("last_update_post_date", False), "start_date": ("start_date", True), "-start_date": ("start_date", False),
    "distance": ("distance_miles", True),
}


@dataclass(frozen=True)
class Wanted:
    """What a search asks for. ``place`` is (latitude, longitude); ``after`` the sort value (or None) and key of the page before's last row."""

    status: str | None = None
    phase: str | None = None
    min_age: float | None = None
    max_age: float | None = None
    sex: str | None = None
    healthy_volunteers: bool | None = None
    std_age_group: str | None = None
    sponsor_class: str | None = None
    intervention_type: str | None = None
    condition: str | None = None
    updated_since: str | None = None
    place: tuple[float, float] | None = None
    radius_miles: float | None = None
    sort: str = "-updated"
    after: tuple | None = None
    size: int = 25


def sited(sites: DataFrame, zips: DataFrame, cities: DataFrame) -> DataFrame:
    """Sites with ``site_latitude``, ``site_longitude``, ``coordinate_source`` (registry, zip, city or NULL) and ``coordinate_approximate``.

    zips: zip, latitude, longitude; cities: state, city_name, city_name_stripped, latitude, longitude. Of several places of a name the
    southernmost, then westernmost counts, whoever asks, so a site stands at one spot.
    """
    one = lambda rows, keys: rows.groupBy(*keys).agg(F.min(F.struct("latitude", "longitude")).alias("at"))
    by_zip = one(zips.withColumnRenamed("zip", "_zip"), ["_zip"]).withColumnRenamed("at", "_by_zip")
    names = F.explode(F.array_distinct(F.array_compact(F.array("city_name", "city_name_stripped")))).alias("_city")
    by_city = one(cities.select(F.col("state").alias("_state"), names, "latitude", "longitude"), ["_state", "_city"]).withColumnRenamed("at", "_by_city")
    rows = sites.join(by_zip, F.left("zip_code", F.lit(5)) == F.col("_zip"), "left")
    rows = rows.join(by_city, (F.col("state_normalized") == F.col("_state")) & (F.col("city_normalized") == F.col("_city")), "left")
    own = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    source = F.when(own, "registry").when(F.col("_zip").isNotNull(), "zip").when(F.col("_state").isNotNull(), "city")
    pick = lambda c: F.when(own, F.col(c)).when(F.col("_zip").isNotNull(), F.col(f"_by_zip.{c}")).otherwise(F.col(f"_by_city.{c}"))
    return rows.select(
        *sites.columns, pick("latitude").alias("site_latitude"), pick("longitude").alias("site_longitude"), source.alias("coordinate_source"), (source != "registry").alias("coordinate_approximate"),
    )


def with_distance(sites: DataFrame, place: tuple[float, float] | None) -> DataFrame:
    """``distance_miles`` from a place; NULL without one, or without a site's coordinates."""
    if place is None:
        return sites.withColumn("distance_miles", F.lit(None).cast("double"))
    return sites.withColumn("distance_miles", haversine_miles(F.lit(float(place[0])), F.lit(float(place[1])), F.col("site_latitude"), F.col("site_longitude")))


def nearest_open(sites: DataFrame, place: tuple[float, float] | None, shown: Sequence[str] = ("facility_name", "city", "state_normalized", "location_status", "coordinate_approximate")) -> DataFrame:
    """Of each record the open site nearest to the place, then of least ordinal: ``nct_id``, ``distance_miles`` and ``nearest_`` columns.

    With a place, sites without any coordinates don't count.
    """
    open_ = sites.where(F.upper("location_status").isin(*OPEN_SITES))
    open_ = with_distance(open_ if place is None else open_.where("coordinate_source IS NOT NULL"), place)
    order = F.struct(F.col("distance_miles").isNull(), "distance_miles", "location_ordinal")
    best = open_.groupBy("nct_id").agg(F.min_by(F.struct("distance_miles", *shown), order).alias("s"))
    return best.select("nct_id", "s.distance_miles", *(F.col(f"s.{c}").alias(f"nearest_{c}") for c in shown))


def matching(trials: DataFrame, wanted: Wanted, sponsors: DataFrame, interventions: DataFrame, conditions: DataFrame, terms: DataFrame) -> DataFrame:
    """The trials that hold every filter but those of distance and of the last update."""
    w, c = wanted, F.col
    upper = lambda x: F.lit(x.upper())
    rules: list[Column] = []
    if w.status is not None:
        rules.append(F.upper("overall_status") == upper(w.status))
    if w.phase is not None:
        rules.append(member_of(F.upper("phase"), upper(w.phase)))
    # an age or a habit that a record doesn't state excludes no one
    if w.min_age is not None:
        rules.append(c("max_age_years").isNull() | (c("max_age_years") >= w.min_age))
    if w.max_age is not None:
        rules.append(c("min_age_years").isNull() | (c("min_age_years") <= w.max_age))
    if w.sex is not None and w.sex.upper() != "ALL":
        rules.append(F.upper(F.coalesce("sex_eligibility", F.lit("ALL"))).isin("ALL", "UNKNOWN", w.sex.upper()))
    if w.healthy_volunteers is not None:
        rules.append(c("accepts_healthy_volunteers").isNull() | (c("accepts_healthy_volunteers") == w.healthy_volunteers))
    if w.std_age_group is not None:
        rules.append(c("std_age_groups").isNull() | F.array_contains("std_age_groups", w.std_age_group))
    found = reduce(DataFrame.where, rules, trials)
    if w.sponsor_class is not None:
        found = any_key_set(found, "nct_id", sponsors.where(c("sponsor_class") == w.sponsor_class))
    if w.intervention_type is not None:
        found = any_key_set(found, "nct_id", interventions.where(F.upper("intervention_type") == upper(w.intervention_type)))
    if w.condition is not None:
        texts = reduce(or_, (F.coalesce(contains_text(c(x), w.condition), F.lit(False)) for x in ("condition_raw", "condition_group", "condition_normalized")))
        named = (F.lower("mesh_term") == w.condition.lower()) | (F.lower("mesh_id") == w.condition.lower())
        found = any_key_set(found, "nct_id", found.where(contains_text(c("brief_title"), w.condition)), conditions.where(texts), terms.where(named))
    return found


def page_of(rows: DataFrame, wanted: Wanted) -> DataFrame:
    """The rows behind ``after`` in the sort's order, NULLs last, and one more that tells whether another page follows. Keys run with the sort's direction."""
    name, up = SORTS[wanted.sort]
    value, key = F.col(name), F.col("nct_id")
    if wanted.after is not None:
        last, last_key = wanted.after
        further = key > last_key if up else key < last_key
        if last is None:
            rows = rows.where(value.isNull() & further)
        else:
            rows = rows.where((value > F.lit(last) if up else value < F.lit(last)) | ((value == F.lit(last)) & further) | value.isNull())
    return rows.orderBy(value.asc_nulls_last() if up else value.desc_nulls_last(), key.asc() if up else key.desc()).limit(wanted.size + 1)


def build_search(trials: DataFrame, sites: DataFrame, sponsors: DataFrame, interventions: DataFrame, conditions: DataFrame, terms: DataFrame, wanted: Wanted) -> DataFrame:
    """A page of matching trials, each with its nearest open site, ``conditions`` (sorted list), ``sponsor_class`` of its lead, and ``total`` of all pages.

    trials: one row each, with the columns that filters and sorts name; sites: as ``sited`` gives them; the others as staged, for the trials' current runs.
    """
    found = matching(trials, wanted, sponsors, interventions, conditions, terms)
    # sites of the matching records only
    near = nearest_open(sites.join(found.select("nct_id"), "nct_id", "left_semi"), wanted.place)
    rows = found.join(near, "nct_id", "left")
    if wanted.place is not None:
        rows = rows.where(F.col("distance_miles") <= (20_000.0 if wanted.radius_miles is None else float(wanted.radius_miles)))
    if wanted.updated_since is not None:
        rows = rows.where(F.col("last_update_post_date") >= F.lit(wanted.updated_since).cast("date"))
    total = rows.agg(F.count("*").alias("total"))  # one row
    page = page_of(rows, wanted)
    # lists and classes are looked up for the page's rows only; they are at most size + 1
    ids = F.broadcast(page.select("nct_id"))
    listed = conditions.join(ids, "nct_id", "left_semi").groupBy("nct_id").agg(F.sort_array(F.collect_set("condition_raw")).alias("conditions"))
    lead = sponsors.where("sponsor_role = 'lead_sponsor'").join(ids, "nct_id", "left_semi").groupBy("nct_id").agg(F.min("sponsor_class").alias("sponsor_class"))
    return page.join(listed, "nct_id", "left").join(lead, "nct_id", "left").crossJoin(F.broadcast(total))


def build_site_details(sites: DataFrame, place: tuple[float, float] | None) -> DataFrame:
    """Sites, open or not, with coordinates, their source, and ``distance_miles`` to one decimal: the child table of a detail document."""
    return with_distance(sites, place).withColumn("distance_miles", F.round("distance_miles", 1))
