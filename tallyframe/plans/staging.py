"""Staging: entity tables of any age to typed columns with fixed names.

A column that an older run doesn't have is NULL. Rows without a record key are dropped, raw text columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..operators.incremental import append_new
from ..sources.sinks import read_run, write_run

# The columns of the staged tables and their types. A bare name is text.
PROVENANCE = ("ingestion_run_id", "indication_profile_id", "nct_id", "source_json_hash")
LOCATIONS = (
    "ingestion_run_id", "snapshot_id", "raw_page_reference", "raw_study_ordinal bigint", "indication_profile_id", "nct_id", "location_ordinal bigint", "facility_name",
    "facility_normalized", "city", "state_normalized", "zip_code", "country", "geo_scope", "latitude double", "longitude double", "location_status",
    "us_location_flag boolean", "usable_geography_flag boolean", "source_json_hash",
)
CONDITIONS = (*PROVENANCE, "condition_raw", "condition_normalized", "condition_group", "dementia_relevance_flag boolean", "mapping_confidence")
MESH = (*PROVENANCE, "mesh_id", "mesh_term", "is_ancestor boolean")
SPONSORS = (*PROVENANCE, "sponsor_name", "sponsor_normalized", "sponsor_role", "sponsor_class")
INTERVENTIONS = (*PROVENANCE, "intervention_name", "intervention_normalized", "intervention_type", "intervention_description")
ARMS = (*PROVENANCE, "arm_ordinal bigint", "arm_label", "arm_type", "arm_description", "intervention_names array<string>")
OUTCOMES = (*PROVENANCE, "outcome_type", "outcome_index bigint", "outcome_measure", "outcome_description", "time_frame")
SNAPSHOTS = (
    "ingestion_run_id", "query_hash", "condition", "mode", "status", "page_count int", "record_count int", "total_count_reported int", "quarantined_record_count int", "profile", "error",
)


def utc(c: Column) -> Column:
    """A timestamp text with a zone (UTC where it has none) as a UTC timestamp, or NULL; the session's zone must be UTC."""
    return c.try_cast("timestamp")


def typed(df: DataFrame, columns: Sequence[str], key: str | None = "nct_id", more: Mapping[str, Column] | None = None) -> DataFrame:
    """The named columns with their types (text that doesn't parse is NULL), those that ``df`` lacks as NULL, then ``more``."""
    def one(named: str) -> Column:
        name, _, kind = named.partition(" ")
        value = F.col(name) if name in df.columns else F.lit(None)
        return value.try_cast(kind or "string").alias(name)

    rows = df.where(F.col(key).isNotNull()) if key else df
    return rows.select(*map(one, columns), *(c.alias(n) for n, c in (more or {}).items()))


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def stage_locations(df: DataFrame) -> DataFrame:
    more = {"retrieved_at_utc": utc(_optional(df, "retrieved_at_utc")), "city_normalized": normalize_text(_optional(df, "city")), "state_raw": _optional(df, "state")}
    return typed(df, LOCATIONS, more=more)


def stage_conditions(df: DataFrame) -> DataFrame:
    """``mapping_source`` where the run has it, else inferred: a rule matched if the confidence isn't low and the group is one."""
    matched = (F.col("mapping_confidence") != "low") & (F.col("condition_group") != "unmapped")
    inferred = F.when(matched, "yaml_overlay").otherwise("text_fallback")
    return typed(df, CONDITIONS, more={"mapping_source": F.coalesce(_optional(df, "mapping_source"), inferred)})


def stage_mesh(df: DataFrame) -> DataFrame:
    return typed(df, MESH)


def stage_sponsors(df: DataFrame) -> DataFrame:
    return typed(df, SPONSORS)


def stage_interventions(df: DataFrame) -> DataFrame:
    return typed(df, INTERVENTIONS)


def stage_arms(df: DataFrame) -> DataFrame:
    return typed(df, ARMS)


def stage_outcomes(df: DataFrame) -> DataFrame:
    return typed(df, OUTCOMES)


def stage_snapshots(manifests: DataFrame) -> DataFrame:
    """One row per run; ``snapshot_date`` is the UTC day on which it started, ``indication_profile_id`` the profile's other name."""
    started, ended = utc(_optional(manifests, "started_at_utc")), utc(_optional(manifests, "ended_at_utc"))
    more = {"started_at_utc": started, "ended_at_utc": ended, "snapshot_date": started.cast("date"), "indication_profile_id": _optional(manifests, "profile")}
    return typed(manifests, SNAPSHOTS, "ingestion_run_id", more)


def materialise(layers: Mapping[str, tuple], root: str) -> dict[str, DataFrame]:
    """Relations by layer: (``view``, df) stays lazy under its name, (``table``, df) is written whole below ``root``, (``log``, df, key) appends rows of new keys.

    A table is a new version that a marker puts in force once it is whole: its plan may read the version before, and a write that breaks off
    leaves that one standing. A log is never rebuilt: it keeps what it has, takes no key twice, and refuses rows of another schema.
    """
    out = {}
    for name, (kind, df, *key) in layers.items():
        if kind == "table":
            write_run({"rows": df}, f"{root}/{name}", "table")
            df = read_run(df.sparkSession, f"{root}/{name}", "table")["rows"]
        elif kind == "log":
            append_new(df, f"{root}/{name}", *key)
            df = df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}")
        elif kind != "view":
            raise ValueError(f"no layer is a {kind}")
        df.createOrReplaceTempView(name)
        out[name] = df
    return out
