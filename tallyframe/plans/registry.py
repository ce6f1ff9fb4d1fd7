"""Registry products over staged tables in full: run reliability, study audit, review queue, and what became of dense segments."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.numbers import safe_divide
from ..functions.text import surrogate_key
from ..operators.relational import null_safe_join

# Fixed values of the products.
ACTIVE = "RECRUITING"
OLD_DAYS = 180
WINDOW_DAYS = 90
NOTE = "Potential competition signal from public registry listings. Not a recruitment forecast; requires human feasibility review."


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.trim(F.col(name).cast("string")) == "")


def _counted(rows: DataFrame, by: list[str], total: str, flags: Mapping[str, Column], *more: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias(total), *(F.count_if(c).alias(n) for n, c in flags.items()), *more)


def build_run_reliability(runs: DataFrame, trials: DataFrame, locations: DataFrame, conditions: DataFrame) -> DataFrame:
    """One row per run of the manifests: reconciliation with the tables, shares of faulty records, usable places, coordinates and mappings.

    A run without rows keeps its manifest's figures and NULLs. The profile is the tables', else the manifest's. A place can fall back on a
    reference file if it has no latitude and either a ZIP or a known city and state.
    """
    run = ["ingestion_run_id"]
    faults = {
        "flagged_record": F.col("record_quality_flag") != "ok", "missing_enrollment": F.col("enrollment_count").isNull(), "missing_start_date": F.col("start_date").isNull(),
        "missing_lead_sponsor": F.col("lead_sponsor_normalized").isNull(),
    }
    per_trial = _counted(trials, run, "trial_row_count", {f"{n}_count": c for n, c in faults.items()}, F.countDistinct("nct_id").alias("distinct_trial_count"), F.min("indication_profile_id").alias("_profile"))
    placed = F.col("city_normalized").isNotNull() & F.col("state_normalized").isNotNull() & (F.col("state_normalized") != "UNKNOWN")
    places = {
        "usable_location_count": F.col("usable_geography_flag"), "coordinates_exact_count": F.col("latitude").isNotNull() & F.col("longitude").isNotNull(),
        "coordinates_fallback_eligible_count": F.col("latitude").isNull() & (~_blank("zip_code") | placed),
    }
    per_place = _counted(locations, run, "location_row_count", places)
    per_condition = _counted(conditions, run, "condition_row_count", {"low_confidence_condition_count": F.col("mapping_confidence") == "low"})
    rows = runs.join(per_trial, run, "left").join(per_place, run, "left").join(per_condition, run, "left")
    share = lambda n, of: safe_divide(F.col(n), F.col(of))
    return rows.select(
        "ingestion_run_id", F.coalesce("_profile", "indication_profile_id").alias("indication_profile_id"), "snapshot_date", "status", F.col("record_count").alias("manifest_record_count"),
        "trial_row_count", "distinct_trial_count", (F.col("trial_row_count") == F.col("record_count")).alias("manifest_reconciled_flag"), (F.col("trial_row_count") == F.col("distinct_trial_count")).alias("unique_nct_flag"),
        "flagged_record_count", *(share(f"{n}_count", "trial_row_count").alias(f"{n}_share") for n in faults), "location_row_count", *places,
        *(share(n, "location_row_count").alias(n.replace("_count", "_share")) for n in places), "condition_row_count", "low_confidence_condition_count",
        share("low_confidence_condition_count", "condition_row_count").alias("low_confidence_condition_share"),
    )


def build_study_audit(trials: DataFrame, runs: DataFrame, locations: DataFrame) -> DataFrame:
    """One row per study of a successful run: what is known of its places and enrollment, the ages of its dates, and whether and why not it counts for a state.

    Enrollment stays with the study; places are only counted. Ages are days since the posted update, and calendar months since the verification
    where its date has a month.
    """
    study = ["indication_profile_id", "snapshot_id", "nct_id"]
    gaps = {
        "usable_location_count": F.col("usable_geography_flag"), "missing_geography_location_count": _blank("country") | (F.col("us_location_flag") & _blank("state_raw")),
        "missing_facility_location_count": _blank("facility_name"),
    }
    places = _counted(locations, study, "recorded_location_count", gaps)
    good = runs.where("status = 'success'").select("ingestion_run_id", "snapshot_date")
    rows = null_safe_join(trials.drop("snapshot_date").join(good, "ingestion_run_id"), places, study, "left")
    geography = F.when(F.col("usable_location_count") > 0, "usable").when(F.col("recorded_location_count").isNull() | (F.col("missing_geography_location_count") > 0), "missing").otherwise("unsupported")
    kind = F.when(F.col("enrollment_count").isNull(), "missing").when(F.col("enrollment_type") == "ESTIMATED", "estimated").when(F.col("enrollment_type") == "ACTUAL", "actual").otherwise("unknown_type")
    posted = F.when(F.col("last_update_post_date_raw").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date("last_update_post_date_raw", "yyyy-MM-dd"))
    rows = rows.withColumns({"geography_category": geography, "enrollment_category": kind, "posted_update_date": posted, "verification_date_precision": dates.date_precision(F.col("status_verified_date_raw")),
                             "confirmed_recruiting_flag": F.coalesce(F.col("overall_status") == ACTIVE, F.lit(False))})
    days = F.datediff("snapshot_date", "posted_update_date")
    months = F.when(F.col("verification_date_precision").isin("month", "day"), dates.month_diff(F.col("snapshot_date"), dates.parse_partial_date(F.col("status_verified_date_raw"))))
    confirmed, category = F.col("confirmed_recruiting_flag"), F.col("geography_category")
    reason = F.when(~confirmed, "not_confirmed_recruiting").when(category == "missing", "missing_geography").when(category == "unsupported", "unsupported_geography")
    return rows.select(
        surrogate_key(*map(F.col, study)).alias("study_audit_key"), *study, "ingestion_run_id", "overall_status", "snapshot_date", "posted_update_date", days.alias("posted_update_age_days"),
        (days > OLD_DAYS).alias("older_posted_update_flag"), "verification_date_precision", months.alias("verification_age_months"), "enrollment_count", "enrollment_category",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("recorded_location_count", *gaps)), "geography_category", "confirmed_recruiting_flag",
        (confirmed & (category == "usable")).alias("state_count_eligible_flag"), reason.alias("state_count_exclusion_reason"),
    )


def latest_of(rows: DataFrame, scope: str, date: str) -> DataFrame:
    """Rows of the latest date of their scope."""
    return rows.join(rows.groupBy(scope).agg(F.max(date).alias(date)), [scope, date], "left_semi")


SEGMENT = ("indication_profile_id", "condition_group", "state_normalized", "phase_normalized")


def build_review_queue(competition: DataFrame, snapshots: DataFrame, sites: DataFrame, overlap: DataFrame, activity: DataFrame, reliability: DataFrame) -> DataFrame:
    """Segments at the latest snapshot of their profile with figures for review, the days of history behind them, and both in words.

    competition: one row per segment and snapshot, with counts, bands and owners; snapshots: profile and date of every observation; sites and overlap: site rows and
    the shared facilities by profile, date and place; activity: records of segments; reliability: as ``build_run_reliability``. The latest
    successful run of each profile gives the share of usable places. ``place`` is the order: most active first, then most owners, then key.
    """
    profile, day = "indication_profile_id", "snapshot_date"
    newest = snapshots.groupBy(profile).agg(F.max(day).alias(day), (F.countDistinct(day) > 1).alias("has_multi_snapshot_history"), F.datediff(F.max(day), F.min(day)).alias("observed_history_days"))
    latest = newest.select(profile, day)
    run = Window.partitionBy(profile).orderBy(F.col(day).desc(), F.col("ingestion_run_id").desc())
    usable = reliability.where("status = 'success'").withColumn("_n", F.row_number().over(run)).where("_n = 1").select(profile, "usable_location_share")
    place = [profile, day, "facility_normalized", "state_normalized", "_city"]
    city = lambda rows: rows.withColumn("_city", F.coalesce("city_normalized", F.lit("")))
    shared = city(overlap.where("repeated_site_participation_flag")).select(*place).distinct()
    overlapping = city(sites.join(latest, [profile, day], "left_semi")).join(shared, place, "left_semi").select(profile, "nct_id").distinct().withColumn("_shared", F.lit(True))
    records = activity.join(latest, [profile, day], "left_semi").where(F.col("overall_status") == ACTIVE).join(overlapping, [profile, "nct_id"], "left")
    per_record = records.groupBy(*SEGMENT, "nct_id").agg(F.bool_or(F.coalesce("_shared", F.lit(False))).alias("_shared"), F.bool_or(F.coalesce(F.col("record_quality_flag") == "ok", F.lit(False))).alias("_ok"))
    shares = per_record.groupBy(*SEGMENT).agg(*(safe_divide(F.count_if(c), F.count("*")).alias(n) for n, c in (("site_overlap_share", "_shared"), ("record_quality_ok_share", "_ok"))))
    rows = competition.join(latest, [profile, day], "left_semi").join(shares, list(SEGMENT)).join(newest.drop(day), profile).join(usable, profile, "left")
    rows = rows.withColumn("operational_completeness_share", 0.5 * F.coalesce("record_quality_ok_share", F.lit(0.0)) + 0.5 * F.coalesce("usable_location_share", F.lit(0.0)))
    text = lambda c: F.col(c).cast("string")
    percent = lambda c: F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("%"))
    growth = (
        F.when(F.col("new_recruiting_90d").isNotNull(), F.concat(text("new_recruiting_90d"), F.lit(f" newly recruiting in {WINDOW_DAYS} days (snapshot transitions; "), text("observed_history_days"), F.lit(" days of history observed)")))
        .when(F.col("observed_history_days") < WINDOW_DAYS, F.concat(F.lit("new recruiting: not enough history ("), text("observed_history_days"), F.lit(f" of {WINDOW_DAYS} days observed)")))
        .otherwise("new recruiting: not enough history (snapshots do not cover the window)")
    )
    owners = F.when(F.col("sponsor_hhi").isNull(), F.concat(F.lit("sponsor concentration: insufficient data ("), text("sponsor_count"), F.lit(" sponsors)"))).otherwise(
        F.concat(F.lit("sponsor concentration HHI "), F.format_number("sponsor_hhi", 2), F.lit(" across "), text("sponsor_count"), F.lit(" sponsor(s)"))
    )
    explained = F.concat_ws(
        "; ", F.concat(text("recruiting_trial_count"), F.lit(" recruiting listing(s) in segment")), growth,
        F.concat(text("newly_registered_90d"), F.lit(f" newly registered within {WINDOW_DAYS} days (registry first-post date, not a recruiting transition)")), owners,
        F.concat(percent(F.coalesce("site_overlap_share", F.lit(0.0))), F.lit(" of trials share a multi-trial facility listing")),
        F.concat(F.lit("operational completeness "), percent(F.col("operational_completeness_share"))),
    )
    out = rows.select(
        surrogate_key(*map(F.col, (*SEGMENT, day))).alias("priority_queue_key"), day, *SEGMENT, "recruiting_trial_count", "listed_site_count", "new_recruiting_90d", "newly_registered_90d",
        "has_multi_snapshot_history", "observed_history_days", "sponsor_count", "top_sponsor_share", "sponsor_hhi", "competition_signal_band", "site_overlap_share", "record_quality_ok_share",
        "operational_completeness_share", explained.alias("priority_explanation"), F.lit(NOTE).alias("interpretation_note"),
    )
    return out.orderBy(F.col("recruiting_trial_count").desc(), F.col("sponsor_count").desc(), "priority_queue_key")


def build_density_outcomes(competition: DataFrame, members: DataFrame, statuses: DataFrame, outcomes: Mapping[str, tuple[str, ...]], few: int) -> DataFrame:
    """What became of active records at their profile's next snapshot, by how dense their segment was.

    competition: ``recruiting_trial_count`` per segment and snapshot; terciles are taken over states within profile, date, group and phase, ties by
    state, and groups of one density are left out. members: active records of segments and dates (SEGMENT, ``snapshot_date``, ``nct_id``); statuses: every record's
    ``overall_status`` per profile and date. Returns for each bin (low, mid, high) records, those gone, the share of each outcome among those seen again, and
    ``inconclusive`` below ``few``.
    """
    profile, day = "indication_profile_id", "snapshot_date"
    days = statuses.select(profile, day).distinct()
    days = days.withColumn("_next", F.lead(day).over(Window.partitionBy(profile).orderBy(day))).where("_next IS NOT NULL")
    group = Window.partitionBy(profile, day, "condition_group", "phase_normalized")
    bins = competition.withColumns({
        "_bin": F.ntile(3).over(group.orderBy("recruiting_trial_count", "state_normalized")), "_low": F.min("recruiting_trial_count").over(group), "_high": F.max("recruiting_trial_count").over(group),
    }).where("_high > _low")
    rows = members.select(*SEGMENT, day, "nct_id").distinct().join(bins.select(*SEGMENT, day, "_bin"), [*SEGMENT, day]).join(days, [profile, day])
    after = statuses.select(F.col(profile).alias("_p"), F.col(day).alias("_d"), F.col("nct_id").alias("_k"), F.col("overall_status").alias("_status"), F.lit(True).alias("_seen")).distinct()
    rows = rows.join(after, (F.col(profile) == F.col("_p")) & (F.col("_next") == F.col("_d")) & (F.col("nct_id") == F.col("_k")), "left")
    seen = F.count_if("_seen")
    shares = (F.round(safe_divide(F.count_if(F.col("_status").isin(*values)), seen), 8).alias(name) for name, values in outcomes.items())
    named = F.element_at(F.array(*map(F.lit, ("low", "mid", "high"))), F.col("_bin"))
    return rows.groupBy(named.alias("density")).agg(F.count("*").alias("n"), F.count_if(F.col("_seen").isNull()).alias("gone"), *shares, (seen < few).alias("inconclusive"))
