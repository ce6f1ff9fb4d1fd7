"""Pages of registry records to entity tables."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyframe.sources import studies

RUN = {"ingestion_run_id": "r1", "indication_profile_id": "p", "snapshot_timestamp_utc": "2026-01-02T00:00:00Z"}
STATES = {"delaware": "DE", "new york": "NY"}


def record(n, **protocol):
    return {"protocolSection": {"identificationModule": {"nctId": n, "briefTitle": "t"}, **protocol}}


FULL = record(
    "NCT00000001",
    statusModule={"overallStatus": "RECRUITING", "startDateStruct": {"date": "2025-03"}, "completionDateStruct": {"date": "2024-01-01", "type": "ACTUAL"}},
    designModule={"studyType": "INTERVENTIONAL", "phases": ["PHASE1", "NA"], "enrollmentInfo": {"count": -1}},
    conditionsModule={"conditions": ["Alzheimer’s Disease", "Early dementia", "Flu"]},
    sponsorCollaboratorsModule={"leadSponsor": {"name": "Ünivers!", "class": "OTHER"}, "collaborators": [{"name": ""}, {"name": "B", "class": "NIH"}]},
    armsInterventionsModule={"armGroups": [{"label": "x", "type": "PLACEBO_COMPARATOR", "interventionNames": ["a", "b"]}, {"label": "y"}], "interventions": [{"name": "Drug A"}]},
    outcomesModule={"primaryOutcomes": [{"measure": "m", "timeFrame": "1 year"}], "otherOutcomes": [{"measure": "o1"}, {"measure": "o2"}]},
    contactsLocationsModule={"locations": [{"facility": "F", "state": "Delaware", "country": "United States", "geoPoint": {"lat": 1.5, "lon": 2}}, {"city": "Paris", "country": "France"}, {"state": "Ohio!", "country": "USA"}, {}]},
) | {"derivedSection": {"conditionBrowseModule": {"meshes": [{"id": "D1", "term": "a"}, {"id": None, "term": "x"}], "ancestors": [{"id": "D1", "term": "a"}, {"id": "D9", "term": "z"}]}}, "hasResults": True, "unknownField": [3, 1]}


@pytest.fixture()
def flat(spark, tmp_path):
    pages = [[FULL, record("NCT00000002"), "text", {"protocolSection": {}}], [record("NCT1"), record("NCT00000002")]]
    for i, p in enumerate(pages):
        (tmp_path / f"page=0000{i}.json").write_text(json.dumps({"studies": p, "totalCount": 9}, indent=2))
    rules = spark.createDataFrame([("substring", "dementia", 1, "dementia", True), ("exact", "alzheimer s disease", 2, "ad", True), ("substring", "alzheimer", 1, "other", False)], "kind string, term string, ord int, label string, relevance boolean")
    return studies.flatten(studies.read_records(spark, f"{tmp_path}/page=*.json"), RUN, STATES, ("united states", "usa"), rules)


def test_stored_records_give_the_same_tables(flat, spark, tmp_path):
    rules = spark.createDataFrame([("exact", "flu", 1, "flu", False)], "kind string, term string, ord int, label string, relevance boolean")
    records = studies.read_records(spark, f"{tmp_path}/page=*.json")
    plain, _ = studies.flatten(records, RUN, STATES, ("usa",), rules, parse_once=False)
    stored, _ = studies.flatten(records, RUN, STATES, ("usa",), rules, store=f"{tmp_path}/work")
    for name, df in plain.items():
        assert stored[name].columns == df.columns and sorted(map(str, stored[name].collect())) == sorted(map(str, df.collect())), name
        assert "page=" not in "".join(stored[name].inputFiles())


def test_stored_quarantine_and_differing_records(spark, tmp_path):
    pages = [[FULL, record("NCT00000002"), "text", {"protocolSection": {}}], [record("NCT1"), record("NCT00000002")], [FULL]]
    for i, p in enumerate(pages):
        (tmp_path / f"page=0000{i}.json").write_text(json.dumps({"studies": p}))
    plain, stored = (studies.flatten(studies.read_records(spark, f"{tmp_path}/page=*.json"), RUN, STATES, ("usa",), store=s, parse_once=bool(s)) for s in (None, f"{tmp_path}/work"))
    assert sorted(map(str, plain[1].collect())) == sorted(map(str, stored[1].collect()))
    first = [(r["nct_id"], r["raw_page_reference"], r["raw_study_ordinal"]) for r in stored[0]["trials"].collect()]
    assert sorted(first) == [("NCT00000001", "page=00000.json", 0), ("NCT00000002", "page=00000.json", 1)]
    (tmp_path / "page=00003.json").write_text(json.dumps({"studies": [record("NCT00000002", designModule={"studyType": "x"})]}))
    with pytest.raises(Exception, match="records differ for NCT00000002"):
        studies.flatten(studies.read_records(spark, f"{tmp_path}/page=*.json"), RUN, STATES, ("usa",), store=f"{tmp_path}/again")


def test_trials_and_quarantine(flat):
    tables, bad = flat
    assert sorted((r["raw_page_reference"], r["raw_study_ordinal"], r["reason"]) for r in bad.collect()) == [("page=00000.json", 2, "NOT_AN_OBJECT"), ("page=00000.json", 3, "MISSING_ID"), ("page=00001.json", 0, "INVALID_ID_FORMAT")]
    trials = {r["nct_id"]: r.asDict() for r in tables["trials"].collect()}
    one, two = trials["NCT00000001"], trials["NCT00000002"]
    assert len(trials) == 2 and two["raw_page_reference"] == "page=00000.json" and two["phase_raw"] is None and two["phase_normalized"] == "UNKNOWN"
    assert (one["phase_raw"], one["phase_normalized"], one["has_placebo_arm"], one["has_results_flag"], one["primary_outcome_time_frame"]) == ("PHASE1|NA", "PHASE1/NOT_APPLICABLE", True, True, "1 year")
    assert one["record_quality_flag"] == "start_after_completion,negative_enrollment" and two["record_quality_flag"] == "missing_overall_status,missing_study_type" and not two["has_placebo_arm"]
    assert one["source_json_hash"] == hashlib.sha256(json.dumps(FULL, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_child_entities(flat):
    t = {k: [r.asDict() for r in df.where("nct_id = 'NCT00000001'").collect()] for k, df in flat[0].items()}
    assert {(r["condition_raw"], r["condition_group"], r["mapping_confidence"], r["mapping_source"]) for r in t["trial_conditions"]} == {("Alzheimer’s Disease", "ad", "high", "yaml_overlay"), ("Early dementia", "dementia", "medium", "yaml_overlay"), ("Flu", "unmapped", "low", "text_fallback")}
    assert {(r["mesh_id"], r["is_ancestor"]) for r in t["trial_condition_mesh"]} == {("D1", False), ("D9", True)}
    assert {(r["sponsor_role"], r["sponsor_normalized"]) for r in t["trial_sponsors"]} == {("lead_sponsor", "ünivers"), ("collaborator", "b")}
    assert [(r["arm_ordinal"], r["intervention_names"]) for r in sorted(t["trial_arms"], key=lambda r: r["arm_ordinal"])] == [(0, ["a", "b"]), (1, None)]
    assert {(r["outcome_type"], r["outcome_index"], r["outcome_measure"]) for r in t["trial_outcomes"]} == {("primary", 0, "m"), ("other", 0, "o1"), ("other", 1, "o2")}
    assert [(r["state_normalized"], r["geo_scope"], r["us_location_flag"], r["usable_geography_flag"], r["latitude"]) for r in sorted(t["trial_locations"], key=lambda r: r["location_ordinal"])] == [
        ("DE", "facility", True, True, 1.5), ("UNKNOWN", "city", False, False, None), ("UNKNOWN", "country", True, False, None), ("UNKNOWN", "unknown", False, False, None)]
    assert t["trial_baseline_demographics"] == [] and t["trial_interventions"][0]["intervention_normalized"] == "drug a"
    registry = studies.registry_grain(flat[0])
    assert all("indication_profile_id" not in df.columns for df in registry.values()) and registry["trial_conditions"].where(F.col("condition_group").isNotNull()).count() == 0
