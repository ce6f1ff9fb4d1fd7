"""Registry records in pages to typed entity tables, for one run.

A page is read with its records as raw JSON text, so that the hash of a record covers all of its fields, also those that
no entity uses. The first record of each key is found by grouping keys, hashes and places, and records are joined to that once.
All records are parsed, hashed and written once, and the nine tables are projections of that table.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import joined_phases
from ..functions.jsons import canonical_hash
from ..functions.text import geo_scope, in_country, nested_flag, normalize_text_unicode, state_code
from ..operators.relational import counted_rules
from ..operators.stages import shared_folder
from .pages import demographics, entity, first_per_key, read_pages, repeated_keys, screen, split_quarantine, terms_once, without_later

_DENOMS = "array<struct<units: string, counts: array<struct<groupId: string, value: string>>>>"
_DATE = "struct<date: string, type: string>"
_OUTCOMES = "array<struct<measure: string, description: string, timeFrame: string>>"
#: Fixed value: the fields of a record that the entities use.
RECORD = f"""protocolSection struct<
  identificationModule: struct<nctId: string, briefTitle: string, officialTitle: string>,
  statusModule: struct<overallStatus: string, lastKnownStatus: string, statusVerifiedDate: string, whyStopped: string, expandedAccessInfo: struct<hasExpandedAccess: boolean>,
    startDateStruct: {_DATE}, primaryCompletionDateStruct: {_DATE}, completionDateStruct: {_DATE}, studyFirstPostDateStruct: {_DATE}, resultsFirstPostDateStruct: {_DATE}, lastUpdatePostDateStruct: {_DATE}>,
  sponsorCollaboratorsModule: struct<leadSponsor: struct<name: string, class: string>, collaborators: array<struct<name: string, class: string>>, responsibleParty: struct<type: string>>,
  designModule: struct<studyType: string, phases: array<string>, enrollmentInfo: struct<count: double, type: string>, designInfo: struct<allocation: string, primaryPurpose: string, interventionModel: string, maskingInfo: struct<masking: string>>>,
  descriptionModule: struct<briefSummary: string>, conditionsModule: struct<conditions: array<string>>,
  armsInterventionsModule: struct<interventions: array<struct<name: string, type: string, description: string>>, armGroups: array<struct<label: string, type: string, description: string, interventionNames: array<string>>>>,
  outcomesModule: struct<primaryOutcomes: {_OUTCOMES}, secondaryOutcomes: {_OUTCOMES}, otherOutcomes: {_OUTCOMES}>,
  eligibilityModule: struct<eligibilityCriteria: string, minimumAge: string, maximumAge: string, sex: string, genderBased: boolean, genderDescription: string, healthyVolunteers: boolean, stdAges: array<string>>,
  contactsLocationsModule: struct<locations: array<struct<facility: string, city: string, state: string, zip: string, country: string, status: string, geoPoint: struct<lat: double, lon: double>>>>>,
 derivedSection struct<conditionBrowseModule: struct<meshes: array<struct<id: string, term: string>>, ancestors: array<struct<id: string, term: string>>>>,
 resultsSection struct<baselineCharacteristicsModule: struct<denoms: {_DENOMS}, groups: array<struct<id: string, title: string>>, measures: array<struct<title: string, paramType: string, unitOfMeasure: string, denoms: {_DENOMS},
   classes: array<struct<title: string, denoms: {_DENOMS}, categories: array<struct<title: string, measurements: array<struct<groupId: string, value: string, spread: string>>>>>>>>>>,
 hasResults boolean"""  # fmt: skip

#: Output column -> module and path below protocolSection.
SCALARS = {
    "brief_title": "identificationModule.briefTitle", "official_title": "identificationModule.officialTitle", "study_type": "designModule.studyType",
    "overall_status": "statusModule.overallStatus", "last_known_status": "statusModule.lastKnownStatus", "status_verified_date": "statusModule.statusVerifiedDate",
    "expanded_access_info": "statusModule.expandedAccessInfo.hasExpandedAccess", "start_date": "statusModule.startDateStruct.date",
    "primary_completion_date": "statusModule.primaryCompletionDateStruct.date", "primary_completion_date_type": "statusModule.primaryCompletionDateStruct.type",
    "completion_date": "statusModule.completionDateStruct.date", "completion_date_type": "statusModule.completionDateStruct.type",
    "study_first_post_date": "statusModule.studyFirstPostDateStruct.date", "results_first_post_date": "statusModule.resultsFirstPostDateStruct.date",
    "last_update_post_date": "statusModule.lastUpdatePostDateStruct.date", "enrollment_count": "designModule.enrollmentInfo.count", "enrollment_type": "designModule.enrollmentInfo.type",
    "allocation": "designModule.designInfo.allocation", "primary_purpose": "designModule.designInfo.primaryPurpose", "intervention_model": "designModule.designInfo.interventionModel",
    "masking": "designModule.designInfo.maskingInfo.masking", "why_stopped": "statusModule.whyStopped", "brief_summary": "descriptionModule.briefSummary",
    "lead_sponsor_name": "sponsorCollaboratorsModule.leadSponsor.name", "responsible_party_type": "sponsorCollaboratorsModule.responsibleParty.type",
    "healthy_volunteers": "eligibilityModule.healthyVolunteers", "minimum_age": "eligibilityModule.minimumAge", "maximum_age": "eligibilityModule.maximumAge", "sex": "eligibilityModule.sex",
    "gender_based": "eligibilityModule.genderBased", "gender_description": "eligibilityModule.genderDescription", "std_age_groups": "eligibilityModule.stdAges",
    "eligibility_criteria_text": "eligibilityModule.eligibilityCriteria",
}
KEYS = ("ingestion_run_id", "indication_profile_id", "nct_id", "source_json_hash", "snapshot_id", "retrieved_at_utc", "raw_page_reference", "raw_study_ordinal")
ID_PATTERN = r"^NCT\d{8}$"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of the pages at ``path`` with page, place, hash and the parsed fields."""
    pages = read_pages(spark, path, spark.range(0).select(F.from_json(F.lit(""), "studies array<string>").alias("s")).select("s.*").schema)
    rows = pages.withColumnsRenamed({"record": "raw", "raw_ordinal": "raw_study_ordinal"})
    return rows.withColumn("source_json_hash", canonical_hash("raw")).withColumn("r", F.from_json("raw", RECORD))


def quality_flag() -> Column:
    """Codes of what is wrong with a trial row; partial dates compare as text, which orders them."""
    return nested_flag(
        (F.col("overall_status").isNull(), "missing_overall_status"), (F.col("study_type").isNull(), "missing_study_type"), (F.col("start_date") > F.col("completion_date"), "start_after_completion"),
        (F.col("results_first_post_date") < F.col("study_first_post_date"), "results_before_first_post"), (F.col("enrollment_count") < 0, "negative_enrollment"),
    )


def map_conditions(conditions: DataFrame, rules: DataFrame | None, default_group: str = "unmapped") -> DataFrame:
    """condition_group, relevance, confidence and source by the first exact rule, else the first substring rule, else the default.

    ``rules`` (kind exact or substring, term, ord, label, relevance) is the taxonomy, a hand-written table of at most ``MOST_RULES`` rows.
    """
    named = conditions.withColumn("condition_normalized", normalize_text_unicode(F.col("condition_raw")))
    if rules is None:
        out = named.withColumns({"condition_group": F.lit(default_group), "dementia_relevance_flag": F.lit(False), "mapping_confidence": F.lit("low")})
    else:
        listed = F.broadcast(counted_rules(rules).groupBy().agg(F.sort_array(F.collect_list(F.struct(F.when(F.col("kind") == "exact", 0).otherwise(1).alias("tier"), "ord", "term", "label", "relevance"))).alias("_rules")))
        text = F.col("condition_normalized")
        hits = F.filter("_rules", lambda r: F.when(r["tier"] == 0, r["term"] == text).otherwise(F.contains(text, r["term"])))
        best = F.get(hits, F.lit(0))
        out = named.crossJoin(listed).withColumn("_best", best)  # the taxonomy as one row
        confidence = F.when(F.col("_best").isNull(), "low").when(F.col("_best.tier") == 0, "high").otherwise("medium")
        out = out.withColumns({"condition_group": F.coalesce("_best.label", F.lit(default_group)), "dementia_relevance_flag": F.coalesce("_best.relevance", F.lit(False)), "mapping_confidence": confidence}).drop("_rules", "_best")
    return out.withColumn("mapping_source", F.when(F.col("mapping_confidence") == "low", "text_fallback").otherwise("yaml_overlay"))


def flatten(
    records: DataFrame, run: Mapping[str, str], states: Mapping[str, str], home: Sequence[str], taxonomy: DataFrame | None = None, sidecars: DataFrame | None = None, store: str | None = None, parse_once: bool = True,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Nine entity tables of one run, and the quarantined records with their reason.

    ``run`` gives ingestion_run_id, indication_profile_id and snapshot_timestamp_utc. Of records with one id the first by
    page and place counts; differing contents stop the job. ``store`` is a folder for the parsed records and the keys that
    repeat, one of the shared folder's own where it isn't given; without ``parse_once`` there is none, and each table parses the pages anew.
    """
    if parse_once and not store:
        store = f"{shared_folder(records.sparkSession)}/studies-{uuid.uuid4().hex}"
    with_time = records.join(sidecars, "raw_page_reference", "left") if sidecars is not None else records.withColumn("retrieved_at_utc", F.lit(None).cast("string"))
    study = F.col("r.protocolSection")
    rows = with_time.withColumn("nct_id", study["identificationModule"]["nctId"])
    screened = screen(rows, F.ltrim("raw").startswith("{"), F.col("nct_id"), ID_PATTERN)
    place = ["raw_page_reference", "raw_study_ordinal"]
    if parse_once:
        kept = screened.withColumn("raw", F.when(F.col("reason").isNotNull(), F.col("raw")))  # only the quarantine shows it
        good, bad = split_quarantine(_written(kept, f"{store}/records"))
        good = without_later(good, _written(repeated_keys(good, "nct_id", "source_json_hash", place), f"{store}/repeated"), "nct_id", place)
    else:
        good, bad = split_quarantine(screened)
        good = first_per_key(good, "nct_id", "source_json_hash", place)
    good = good.withColumns({"ingestion_run_id": F.lit(run["ingestion_run_id"]), "snapshot_id": F.lit(run["ingestion_run_id"]), "indication_profile_id": F.lit(run["indication_profile_id"])})
    base = good.select(*KEYS, "r.protocolSection", "r.derivedSection", "r.resultsSection", "r.hasResults")
    keys, at = list(KEYS), "protocolSection"
    arms, first_outcome = F.col(f"{at}.armsInterventionsModule.armGroups"), F.get(F.col(f"{at}.outcomesModule.primaryOutcomes"), F.lit(0))
    raw_phase, phase = joined_phases(F.col(f"{at}.designModule.phases"))
    trials = base.select(
        *keys, F.lit(run["snapshot_timestamp_utc"]).alias("snapshot_timestamp_utc"), *(F.col(f"{at}.{path}").alias(name) for name, path in SCALARS.items()), raw_phase.alias("phase_raw"), phase.alias("phase_normalized"),
        F.coalesce(F.exists(arms, lambda a: F.coalesce(a["type"] == "PLACEBO_COMPARATOR", F.lit(False))), F.lit(False)).alias("has_placebo_arm"), first_outcome["timeFrame"].alias("primary_outcome_time_frame"),
        F.coalesce("hasResults", F.lit(False)).alias("has_results_flag"),
    ).withColumn("record_quality_flag", quality_flag())

    conditions = base.select(*keys, F.explode(f"{at}.conditionsModule.conditions").alias("condition_raw"))
    mesh = base.select(*keys, F.explode(terms_once("derivedSection.conditionBrowseModule.meshes", "derivedSection.conditionBrowseModule.ancestors")).alias("m"))
    mesh = mesh.select(*keys, F.col("m.id").alias("mesh_id"), F.col("m.term").alias("mesh_term"), "m.is_ancestor", F.lit(None).cast("string").alias("branch"))
    interventions = entity(base, keys, f"{at}.armsInterventionsModule.interventions", {"intervention_name": "name", "intervention_type": "type", "intervention_description": "description"})
    interventions = interventions.withColumn("intervention_normalized", normalize_text_unicode(F.col("intervention_name")))
    arm_rows = entity(base, keys, f"{at}.armsInterventionsModule.armGroups", {"arm_label": "label", "arm_type": "type", "arm_description": "description", "intervention_names": "interventionNames"}, "arm_ordinal")
    sponsor = F.col(f"{at}.sponsorCollaboratorsModule")
    role = lambda s, name: F.struct(F.lit(name).alias("role"), s["name"].alias("name"), s["class"].alias("class"))
    every = F.concat(F.array(role(sponsor["leadSponsor"], "lead_sponsor")), F.transform(F.coalesce(sponsor["collaborators"], F.array()), lambda s: role(s, "collaborator")))
    sponsors = base.select(*keys, F.explode(F.filter(every, lambda s: s["name"].isNotNull() & (s["name"] != ""))).alias("s"))
    sponsors = sponsors.select(*keys, F.col("s.name").alias("sponsor_name"), F.col("s.role").alias("sponsor_role"), F.col("s.class").alias("sponsor_class"), normalize_text_unicode(F.col("s.name")).alias("sponsor_normalized"))

    places = entity(base, keys, f"{at}.contactsLocationsModule.locations", {"facility_name": "facility", "city": "city", "state": "state", "zip_code": "zip", "country": "country", "latitude": "geoPoint.lat", "longitude": "geoPoint.lon", "location_status": "status"}, "location_ordinal")
    code = state_code(F.col("state"), dict(states))
    places = places.withColumn("facility_normalized", normalize_text_unicode(F.col("facility_name"))).withColumn("state_normalized", F.coalesce(code, F.lit("UNKNOWN")))
    places = places.withColumn("geo_scope", geo_scope(F.col("facility_name"), F.col("city"), F.col("state_normalized"), F.col("country"))).withColumn("us_location_flag", in_country(F.col("country"), home))
    places = places.withColumn("usable_geography_flag", F.col("us_location_flag") & (F.col("state_normalized") != "UNKNOWN"))

    kinds = [("primary", "primaryOutcomes"), ("secondary", "secondaryOutcomes"), ("other", "otherOutcomes")]
    laid = F.concat(*(_numbered(f"{at}.outcomesModule.{path}", kind) for kind, path in kinds))
    outcomes = base.select(*keys, F.explode(laid).alias("o")).select(*keys, "o.*")
    baseline = demographics(base.select(*keys, F.col("resultsSection.baselineCharacteristicsModule").alias("baseline")), keys)
    tables = {
        "trials": trials, "trial_conditions": map_conditions(conditions, taxonomy), "trial_condition_mesh": mesh, "trial_interventions": interventions, "trial_arms": arm_rows, "trial_sponsors": sponsors,
        "trial_locations": places, "trial_outcomes": outcomes, "trial_baseline_demographics": baseline,
    }
    return tables, bad.select("raw_page_reference", "raw_study_ordinal", "nct_id", "reason", "raw")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _numbered(path: str, kind: str) -> Column:
    """A list of outcomes with its kind and each one's place in it."""
    row = lambda o, i: F.struct(F.lit(kind).alias("outcome_type"), i.cast("long").alias("outcome_index"), o["measure"].alias("outcome_measure"), o["description"].alias("outcome_description"), o["timeFrame"].alias("time_frame"))
    return F.transform(F.coalesce(F.col(path), F.array()), row)


def registry_grain(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The same rows without the profile, the taxonomy's columns set to NULL."""
    blank = ("condition_group", "dementia_relevance_flag", "mapping_confidence", "mapping_source")
    return {name: df.drop("indication_profile_id").withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in blank if c in df.columns}) for name, df in tables.items()}
