"""Each rule of the registry products has a row here."""

from __future__ import annotations

import datetime as dt

from tallyframe.plans import registry

D = dt.date


def test_run_reliability(spark):
    make = spark.createDataFrame
    runs = make([("r1", "default", D(2025, 1, 1), "success", 3), ("r2", "q", D(2025, 1, 2), "success", 9), ("r3", "full", D(2025, 1, 3), "failed", 1)], "ingestion_run_id string, indication_profile_id string, snapshot_date date, status string, record_count int")
    trials = make([("r1", "p", "N1", "ok", 5, D(2020, 1, 1), "x"), ("r1", "p", "N2", "missing_status", None, None, "x"), ("r1", "p", "N3", None, 5, None, None), ("r2", "q", "N1", "ok", 1, None, "x"), ("r2", "q", "N1", "ok", 1, None, "x")],
                  "ingestion_run_id string, indication_profile_id string, nct_id string, record_quality_flag string, enrollment_count int, start_date date, lead_sponsor_normalized string")
    places = make([("r1", True, 1.0, 2.0, None, None, None), ("r1", False, None, 2.0, "  ", "t", "UNKNOWN"), ("r1", None, None, None, "02139", None, None), ("r1", True, None, None, "", "t", "MA"), ("r1", False, 1.0, None, "02139", "t", "MA")],
                  "ingestion_run_id string, usable_geography_flag boolean, latitude double, longitude double, zip_code string, city_normalized string, state_normalized string")
    conditions = make([("r1", "low"), ("r1", None), ("r1", "high")], "ingestion_run_id string, mapping_confidence string")
    got = {r["ingestion_run_id"]: r.asDict() for r in registry.build_run_reliability(runs, trials, places, conditions).collect()}
    one = got["r1"]
    assert (one["indication_profile_id"], one["manifest_reconciled_flag"], one["unique_nct_flag"], one["flagged_record_count"]) == ("p", True, True, 1)
    assert [round(one[f"{n}_share"], 4) for n in ("flagged_record", "missing_enrollment", "missing_start_date", "missing_lead_sponsor", "low_confidence_condition")] == [0.3333, 0.3333, 0.6667, 0.3333, 0.3333]
    assert (one["location_row_count"], one["usable_location_count"], one["coordinates_exact_count"], one["coordinates_fallback_eligible_count"], one["coordinates_exact_share"]) == (5, 2, 1, 2, 0.2)
    assert (got["r2"]["manifest_reconciled_flag"], got["r2"]["unique_nct_flag"], got["r2"]["usable_location_share"]) == (False, False, None)
    assert (got["r3"]["indication_profile_id"], got["r3"]["trial_row_count"], got["r3"]["manifest_reconciled_flag"]) == ("full", None, None)


def test_study_audit(spark):
    make = spark.createDataFrame
    runs = make([("r", D(2025, 7, 15), "success"), ("bad", D(2025, 7, 16), "failed")], "ingestion_run_id string, snapshot_date date, status string")
    studies = [
        ("A", "RECRUITING", 5, "ESTIMATED", "2025-01-15", "2025-05"), ("B", "RECRUITING", None, "ACTUAL", "2025-01-16", "2025-05-31"), ("C", "RECRUITING", 5, "ACTUAL", "2025-1-2", "2024"), ("D", None, 5, None, None, " "),
        ("E", "COMPLETED", 0, "x", "2025-02-30", "2025-13"), ("F", "RECRUITING", 1, "ACTUAL", "2025-07-15", "2025-07-01"),
    ]
    trials = make([("r", "s", "p", *x) for x in studies] + [("bad", "s2", "p", *studies[0])], "ingestion_run_id string, snapshot_id string, indication_profile_id string, nct_id string, overall_status string, enrollment_count int, enrollment_type string, last_update_post_date_raw string, status_verified_date_raw string")
    places = make([("p", "s", "A", True, "US", True, "MA", "f"), ("p", "s", "A", False, None, False, None, " "), ("p", "s", "B", False, "US", True, "  ", "f"), ("p", "s", "C", False, "FR", False, None, None), ("p", "other", "F", True, "US", True, "MA", "f")],
                  "indication_profile_id string, snapshot_id string, nct_id string, usable_geography_flag boolean, country string, us_location_flag boolean, state_raw string, facility_name string")
    got = {r["nct_id"]: r for r in registry.build_study_audit(trials, runs, places).collect()}
    shown = {k: (r["geography_category"], r["enrollment_category"], r["verification_date_precision"], r["verification_age_months"], r["posted_update_age_days"], r["older_posted_update_flag"], r["state_count_eligible_flag"], r["state_count_exclusion_reason"]) for k, r in got.items()}
    assert shown == {
        "A": ("usable", "estimated", "month", 2, 181, True, True, None), "B": ("missing", "missing", "day", 2, 180, False, False, "missing_geography"), "C": ("unsupported", "actual", "year", None, None, None, False, "unsupported_geography"),
        "D": ("missing", "unknown_type", "missing", None, None, None, False, "not_confirmed_recruiting"), "E": ("missing", "unknown_type", "unparseable", None, None, None, False, "not_confirmed_recruiting"),
        "F": ("missing", "actual", "day", 0, 0, False, False, "missing_geography"),
    }
    assert (got["A"]["recorded_location_count"], got["A"]["missing_geography_location_count"], got["A"]["missing_facility_location_count"], got["F"]["recorded_location_count"]) == (2, 1, 1, 0)


def test_review_queue(spark):
    make = spark.createDataFrame
    seg = "indication_profile_id string, condition_group string, state_normalized string, phase_normalized string"
    old, new = D(2025, 1, 1), D(2025, 6, 1)
    competition = make([
        ("p", "g", "MA", "P1", new, 3, 5, 2, 4, 3, 0.5, 0.335, "low"), ("p", "g", "MA", "P1", old, 9, 9, 9, 9, 9, 0.9, 0.9, "low"), ("p", "h", "MA", "P1", new, 3, 1, None, 0, 2, 0.6, None, "low"), ("q", "g", "MA", "P1", old, 7, 1, None, 1, 4, 0.4, 0.25, "low"),
    ], f"{seg}, snapshot_date date, recruiting_trial_count int, listed_site_count int, new_recruiting_90d int, newly_registered_90d int, sponsor_count int, top_sponsor_share double, sponsor_hhi double, competition_signal_band string")
    snapshots = make([("p", old), ("p", new), ("q", old)], "indication_profile_id string, snapshot_date date")
    place = "indication_profile_id string, snapshot_date date, facility_normalized string, city_normalized string, state_normalized string"
    sites = make([("p", new, "f", None, "MA", "N1"), ("p", new, "f", "x", "MA", "N2"), ("p", old, "f", None, "MA", "N3")], f"{place}, nct_id string")
    overlap = make([("p", new, "f", "", "MA", True), ("p", new, "f", "x", "MA", False), ("p", old, "f", None, "MA", True)], f"{place}, repeated_site_participation_flag boolean")
    act = lambda k, g="g", p="p", d=new, s="RECRUITING", f="ok": (p, g, "MA", "P1", d, k, s, f)
    activity = make([act("N1"), act("N1"), act("N2", f="bad"), act("N3", f=None), act("N4", s="COMPLETED"), act("N5", d=old), act("N1", "h"), act("N9", p="q", d=old)], f"{seg}, snapshot_date date, nct_id string, overall_status string, record_quality_flag string")
    runs = make([("p", "a", old, "success", 0.1), ("p", "b", new, "success", 0.5), ("p", "c", new, "failed", 0.9)], "indication_profile_id string, ingestion_run_id string, snapshot_date date, status string, usable_location_share double")
    got = registry.build_review_queue(competition, snapshots, sites, overlap, activity, runs).collect()
    assert [(r["indication_profile_id"], r["condition_group"], r["snapshot_date"]) for r in got] == [("q", "g", old), ("p", "g", new), ("p", "h", new)]
    one = got[1]
    assert (round(one["site_overlap_share"], 4), round(one["record_quality_ok_share"], 4), round(one["operational_completeness_share"], 4), one["observed_history_days"], one["has_multi_snapshot_history"]) == (0.3333, 0.3333, 0.4167, 151, True)
    assert one["priority_explanation"] == (
        "3 recruiting listing(s) in segment; 2 newly recruiting in 90 days (snapshot transitions; 151 days of history observed); 4 newly registered within 90 days (registry first-post date, not a recruiting transition); "
        "sponsor concentration HHI 0.34 across 3 sponsor(s); 33% of trials share a multi-trial facility listing; operational completeness 42%"
    )
    assert "not enough history (snapshots do not cover the window)" in got[2]["priority_explanation"] and "insufficient data (2 sponsors)" in got[2]["priority_explanation"]
    assert "not enough history (0 of 90 days observed)" in got[0]["priority_explanation"] and got[0]["operational_completeness_share"] == 0.5


def test_density_outcomes(spark):
    make = spark.createDataFrame
    one, two = D(2025, 1, 1), D(2025, 2, 1)
    seg = "indication_profile_id string, condition_group string, state_normalized string, phase_normalized string"
    dense = [("A", 1), ("B", 1), ("C", 2), ("D", 3)]  # ties by state: A, B are low, C is mid, D is high
    competition = make([("p", "g", s, "P1", one, n) for s, n in dense] + [("p", "flat", s, "P1", one, 4) for s in "AB"] + [("p", "g", "A", "P1", two, 1), ("p", "g", "B", "P1", two, 2)], f"{seg}, snapshot_date date, recruiting_trial_count int")
    members = make([("p", "g", s, "P1", one, k) for s, k in (("A", "1"), ("B", "2"), ("B", "2"), ("C", "3"), ("D", "4"), ("D", "5"))] + [("p", "flat", "A", "P1", one, "6"), ("p", "g", "A", "P1", two, "1")], f"{seg}, snapshot_date date, nct_id string")
    statuses = make([("p", one, str(k), "RECRUITING") for k in range(1, 7)] + [("p", two, "1", "COMPLETED"), ("p", two, "2", "RECRUITING"), ("p", two, "4", "WITHDRAWN"), ("p", two, "5", None), ("q", D(2025, 1, 15), "1", "x")], "indication_profile_id string, snapshot_date date, nct_id string, overall_status string")
    got = {r["density"]: (r["n"], r["gone"], r["done"], r["stopped"], r["inconclusive"]) for r in registry.build_density_outcomes(competition, members, statuses, {"done": ("COMPLETED",), "stopped": ("WITHDRAWN", "TERMINATED")}, 2).collect()}
    assert got == {"low": (2, 0, 0.5, 0.0, False), "mid": (1, 1, None, None, True), "high": (2, 0, 0.0, 0.5, False)}
