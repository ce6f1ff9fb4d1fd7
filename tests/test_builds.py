"""Manifests, seeds, extracts, staging of registry tables, layers and distances across the date line."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.numbers import haversine_miles
from tallyframe.operators.relational import within_miles
from tallyframe.plans import dimensions, reports, staging
from tallyframe.sources import manifests


def test_manifests_of_several_profiles(spark, tmp_path):
    runs = [{"ingestion_run_id": "a", "profile": "p", "status": "success", "started_at_utc": "2026-01-01T23:30:00-05:00", "record_count": 5}, {"ingestion_run_id": "b", "profile": "q", "status": "failed", "error": "x", "new": 1}]
    for r in runs:
        (tmp_path / f"{r['profile']}.json").write_text(json.dumps(r, indent=1))
    staged = {r["ingestion_run_id"]: r for r in staging.stage_snapshots(manifests.read_manifests(spark, f"{tmp_path}/p.json", f"{tmp_path}/q.json")).collect()}
    assert str(staged["a"]["snapshot_date"]) == "2026-01-02" and staged["a"]["indication_profile_id"] == "p" and staged["a"]["record_count"] == 5
    assert staged["b"]["error"] == "x" and staged["b"]["snapshot_date"] is None


def test_seeds_are_typed(spark, tmp_path):
    (tmp_path / "weights.csv").write_text("factor,weight\nphase,0.2\n")
    (tmp_path / "bad.csv").write_text("factor,weight\nphase,much\n")
    assert manifests.read_seeds(spark, str(tmp_path), {"weights": "factor string, weight double"})["weights"].collect() == [("phase", 0.2)]
    with pytest.raises(Exception, match="much|FAILFAST|Malformed|malformed"):
        manifests.read_seeds(spark, str(tmp_path), {"bad": "factor string, weight double"})["bad"].collect()


def test_extracts_carry_the_day_of_their_name(spark, tmp_path):
    head = "nct_id,overall_status,start_date,primary_completion_date,completion_date"
    for day, status in (("20250101", "Recruiting "), ("20250201", "RECRUITING"), ("20250301", "Completed")):
        (tmp_path / f"studies_{day}.csv").write_text(f"{head}\nN1,{status},2020,,\nN2,Withdrawn,,,\n")
    rows = {(r["nct_id"], str(r["snapshot_date"])): r for r in manifests.extract_history(manifests.read_extracts(spark, f"{tmp_path}/studies_*.csv")).collect()}
    assert len(rows) == 6 and not rows["N1", "2025-02-01"]["status_changed"]
    last = rows["N1", "2025-03-01"]
    assert (last["status_changed"], last["entered"], last["left"], last["previous_status"]) == (True, False, True, "RECRUITING")
    (tmp_path / "other.csv").write_text(f"{head}\nN1,x,,,\n")
    with pytest.raises(Exception, match="not a dated extract"):
        manifests.read_extracts(spark, f"{tmp_path}/*.csv").collect()


def test_guards_name_what_forbids_a_rebuild(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2"), (None, "3")], "k string, h string")
    main = rows.where("k IS NOT NULL").dropDuplicates(["k"])
    stats = manifests.transform_stats(rows, {"trials": main}, "r", "k", "h", 4)
    assert stats.select(manifests.expected_rows(F.struct("*"))).first()[0] == 2
    assert manifests.guard_rebuild(main, stats, main).collect() == []
    assert {r["guard"] for r in manifests.guard_rebuild(main.limit(1), stats, main).collect()} == {"manifest", "statistics", "retained"}
    profile = manifests.reconciled_profile(main, "k", spark.createDataFrame([(2,)], "n long")).collect()
    assert all(r["reconciled"] for r in profile) and len(profile) == 2


def test_old_runs_lack_columns_and_layers_are_views_or_tables(spark, tmp_path):
    old = spark.createDataFrame([("N1", "high", "ad"), ("N2", "low", "ad"), ("N3", "high", "unmapped"), (None, "high", "ad")], "nct_id string, mapping_confidence string, condition_group string")
    staged = staging.stage_conditions(old)
    assert {r["nct_id"]: r["mapping_source"] for r in staged.collect()} == {"N1": "yaml_overlay", "N2": "text_fallback", "N3": "text_fallback"}
    sites = spark.createDataFrame([("N1", "x", "St. Paul", "12.5")], "nct_id string, location_ordinal string, city string, latitude string")
    row = staging.stage_locations(sites).first()
    assert (row["location_ordinal"], row["city_normalized"], row["latitude"], row["zip_code"]) == (None, "st paul", 12.5, None)
    layers = staging.materialise({"stg_conditions": ("view", staged), "mart_sources": ("table", staged.groupBy("mapping_source").count())}, str(tmp_path))
    assert spark.table("mart_sources").count() == 2 and layers["mart_sources"].inputFiles() and not layers["stg_conditions"].inputFiles()


def test_layers_are_refreshed_whole_or_not_at_all(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    read = lambda out, name: sorted(map(tuple, out[name].collect()))
    first = staging.materialise({"mart": ("table", rows), "events": ("log", rows, "k")}, str(tmp_path))
    # the new version is made of the old one
    again = first["mart"].withColumn("v", F.upper("v")).unionByName(rows.where("k = 1"))
    more = spark.createDataFrame([(2, "other"), (3, "c"), (3, "c")], rows.schema)
    second = staging.materialise({"mart": ("table", again), "events": ("log", more, "k")}, str(tmp_path))
    assert read(second, "mart") == [(1, "A"), (1, "a"), (2, "B")] and read(second, "events") == [(1, "a"), (2, "b"), (3, "c")]
    broken = rows.withColumn("v", F.raise_error(F.lit("disk is gone")).cast("string"))
    with pytest.raises(Exception, match="disk is gone"):
        staging.materialise({"mart": ("table", broken)}, str(tmp_path))
    assert read(staging.materialise({"copy": ("view", spark.table("mart"))}, str(tmp_path)), "copy") == read(second, "mart")
    with pytest.raises(ValueError, match="schema changed"):
        staging.materialise({"events": ("log", rows.withColumn("z", F.lit(1)), "k")}, str(tmp_path))
    with pytest.raises(ValueError, match="no layer"):
        staging.materialise({"x": ("cube", rows)}, str(tmp_path))


def test_detail_documents_and_explorer(spark):
    trials = spark.createDataFrame([("N1",), ("N2",)], "nct_id string")
    sites = spark.createDataFrame([("N1", 1, "NY", True), ("N1", 0, "DE", True), ("N1", 2, "PA", False)], "nct_id string, ord int, state string, ok boolean")
    docs = {r["nct_id"]: [s["state"] for s in r["sites"]] for r in reports.build_detail_documents(trials, "nct_id", {"sites": (sites, ["ord"], ["state", "ok"])}).collect()}
    assert docs == {"N1": ["DE", "NY", "PA"], "N2": []}
    shown = {r["nct_id"]: (r["site_states"], r["n_sites"]) for r in reports.build_explorer(trials, "nct_id", sites, "state", F.col("ok")).collect()}
    assert shown == {"N1": ("DE, NY", 2), "N2": (None, 0)}


def test_products_on_registry_tables(spark):
    rows = spark.createDataFrame([("N1", "Alzheimer's Disease", "D1", False), ("N1", "Alzheimer's Disease", "D9", True), ("N2", "Flu", "D9", True)], "nct_id string, grp string, mesh string, up boolean")
    bridge = dimensions.build_condition_bridge(rows, ["nct_id"], F.col("grp"), F.col("mesh"), F.col("up"))
    nodes = {r["node"]: (r["n"], r["is_ancestor_only"]) for r in dimensions.build_condition_dimension(bridge, "nct_id").collect()}
    assert nodes == {"group:alzheimers-disease": (1, False), "group:flu": (1, False), "D1": (1, False), "D9": (2, True)}
    presets = spark.createDataFrame([("p", " FLU"), ("q", "none")], "preset string, term string")
    members = {tuple(r) for r in dimensions.build_membership(rows, "nct_id", F.col("grp"), presets).collect()}
    assert members == {("p", "N2"), ("unassigned", "N1")}


def test_distances_across_the_date_line_and_near_a_pole(spark):
    points = [(0, 51.9, 179.95), (1, 51.9, -179.95), (2, 51.9, 0.0), (3, 89.7, 10.0), (4, 89.7, -170.0), (5, -180.0 * 0, 180.0), (6, 0.0, -180.0)]
    df = spark.createDataFrame(points, "k int, lat double, lon double")
    side = lambda s: df.select(F.col("k").alias(s), F.col("lat").alias(f"{s}_lat"), F.col("lon").alias(f"{s}_lon"))
    miles = haversine_miles(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    got = [(r["a"], r["b"]) for r in within_miles(side("a"), side("b"), 50, miles).collect()]
    want = {(r["a"], r["b"]) for r in side("a").crossJoin(side("b")).withColumn("miles", miles).where("miles <= 50").collect()}
    assert len(got) == len(set(got)) and set(got) == want and {(0, 1), (3, 4), (5, 6)} <= want
