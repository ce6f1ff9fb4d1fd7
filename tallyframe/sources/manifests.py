"""Run manifests, statistics of a transform, dated extracts and typed seeds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relational import profile
from .pages import dedup_stats

#: Fixed value: the fields of a run's manifest. A file that lacks one has NULL there.
MANIFEST = """ingestion_run_id string, query_hash string, condition string, mode string, status string, started_at_utc string, ended_at_utc string, page_count bigint,
record_count bigint, total_count_reported bigint, quarantined_record_count bigint, profile string, error string"""
#: Fixed value: the columns of a dated extract.
EXTRACT = ("nct_id", "overall_status", "start_date", "primary_completion_date", "completion_date")


def read_manifests(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per run of all profiles' JSON manifests; the fields are matched by name."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(list(paths))


def read_seeds(spark: SparkSession, folder: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """CSV files with a header as typed tables; a value that isn't of its type stops the job."""
    return {name: spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(f"{folder}/{name}.csv") for name, schema in schemas.items()}


def transform_stats(records: DataFrame, tables: Mapping[str, DataFrame], run_id: str, key: str, content_hash: str, manifest_count: int, carried: int = 0) -> DataFrame:
    """One row of a run's statistics: manifest count, duplicates dropped, records without key, rows carried over, and rows per entity."""
    dedup = dedup_stats(records, key, content_hash)
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")
        counts = one if counts is None else counts.unionByName(one)
    per_entity = counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity", "n")))).alias("entity_rows"))
    named = dedup.select(F.lit(run_id).alias("run_id"), F.lit(manifest_count).cast("long").alias("manifest_count"), "n_records", "n_duplicates", "n_missing", F.lit(carried).cast("long").alias("n_carried"))
    return named.crossJoin(F.broadcast(per_entity))  # one row each


def expected_rows(stats: Column | str) -> Column:
    """Rows that a run's main table must have: the manifest's, less duplicates and records without key, and those carried over."""
    s = F.col(stats) if isinstance(stats, str) else stats
    return s["manifest_count"] - s["n_duplicates"] - s["n_missing"] + s["n_carried"]


def guard_rebuild(new: DataFrame, stats: DataFrame, retained: DataFrame | None = None, main: str = "trials") -> DataFrame:
    """What forbids replacing a run by ``new`` (its main table): one row per guard that fails, none if all hold.

    It may have no fewer rows than the manifest and the statistics lead to, and than the run that it would replace.
    """
    n = new.agg(F.count("*").alias("n_new"))
    checks = [("manifest", expected_rows(F.struct("*"))), ("statistics", F.get(F.array(F.col("entity_rows")[main]), F.lit(0)))]
    row = stats.select(*(c.alias(name) for name, c in checks)).crossJoin(F.broadcast(n))  # one row each
    names = [name for name, _ in checks]
    if retained is not None:
        row = row.crossJoin(F.broadcast(retained.agg(F.count("*").alias("retained"))))
        names.append("retained")
    laid = row.select("n_new", F.explode(F.array(*(F.struct(F.lit(c).alias("guard"), F.col(c).alias("expected")) for c in names))).alias("g"))
    return laid.where("n_new < g.expected").select("g.guard", "g.expected", "n_new")


def reconciled_profile(df: DataFrame, key: str, expected: DataFrame) -> DataFrame:
    """The profile of a table's columns with the rows it should have (``expected``: one row, one number) and whether it does."""
    wanted = expected.select(F.col(expected.columns[0]).alias("n_expected"))
    rows = profile(df, key).crossJoin(F.broadcast(wanted))  # one row
    return rows.withColumn("reconciled", F.col("n_rows").eqNullSafe(F.col("n_expected")))


def read_extracts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of extracts named ``studies_YYYYMMDD.csv`` with the day in the name; another name stops the job."""
    raw = spark.read.option("header", True).csv(path)
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    day = F.regexp_extract(file, r"^studies_(\d{8})\.csv$", 1)
    checked = F.when(day == "", F.raise_error(F.concat(F.lit("not a dated extract: "), file))).otherwise(F.to_date(day, "yyyyMMdd"))
    return raw.select(*EXTRACT, checked.alias("snapshot_date"))


def extract_history(rows: DataFrame, active: str = "RECRUITING") -> DataFrame:
    """One row per record and day with what changed since its extract before; of rows with one key and day the least hash counts."""
    named = rows.withColumn("overall_status", F.upper(F.trim("overall_status")))
    named = named.withColumn("record_hash", F.sha2(F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in EXTRACT)), 256))
    one = named.groupBy("nct_id", "snapshot_date").agg(F.min_by(F.struct("overall_status", "record_hash"), "record_hash").alias("r")).select("nct_id", "snapshot_date", "r.*")
    over = Window.partitionBy("nct_id").orderBy("snapshot_date")
    out = one.withColumn("previous_status", F.lag("overall_status").over(over)).withColumn("previous_date", F.lag("snapshot_date").over(over))
    seen, now, before = F.col("previous_date").isNotNull(), F.col("overall_status").eqNullSafe(F.lit(active)), F.col("previous_status").eqNullSafe(F.lit(active))
    return out.withColumns({"status_changed": seen & ~F.col("overall_status").eqNullSafe(F.col("previous_status")), "entered": seen & now & ~before, "left": seen & before & ~now})
