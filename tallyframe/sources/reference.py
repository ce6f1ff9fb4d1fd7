"""Reference files: tolerant scans, seeds, gazetteers, population, burden and county context."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", **options: object) -> DataFrame:
    """The table at ``path`` with the declared columns (missing ones NULL), or an empty one where there is no such path."""
    reader = spark.read.schema(schema).options(**options)
    try:
        return reader.format(kind).load(path)
    except AnalysisException as gone:
        if "PATH_NOT_FOUND" not in str(gone):
            raise
        return spark.createDataFrame([], schema)


def with_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Columns that a late version added: a default where the table doesn't have them."""
    return df.withColumns({c: default for c, default in defaults.items() if c not in df.columns})


def runs_without(entity: DataFrame, companion: DataFrame, run: str) -> DataFrame:
    """Runs that have rows of one entity but none of the other."""
    return entity.select(run).distinct().join(companion.select(run).distinct(), run, "left_anti")


def gazetteer(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """geo_id, name, state, latitude, longitude; padded headers trimmed, points off the globe dropped; empty without a file."""
    try:
        raw = spark.read.option("header", True).option("sep", sep).csv(path)
    except AnalysisException as gone:
        if "PATH_NOT_FOUND" not in str(gone):
            raise
        return spark.createDataFrame([], "geo_id string, name string, state string, latitude double, longitude double")
    raw = raw.toDF(*(c.strip() for c in raw.columns))
    col = lambda c: F.trim(F.col(c)) if c in raw.columns else F.lit(None).cast("string")
    rows = raw.select(col("GEOID").alias("geo_id"), col("NAME").alias("name"), col("USPS").alias("state"), col("INTPTLAT").try_cast("double").alias("latitude"), col("INTPTLONG").try_cast("double").alias("longitude"))
    return rows.where("latitude between -90 and 90 and longitude between -180 and 180")


def melted(df: DataFrame, keys: Sequence[str], measures: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Wide estimates to long rows: ``measures`` maps a label to its estimate and margin columns; negative marks become NULL."""
    known = lambda c: F.when(F.col(c) >= 0, F.col(c))
    cells = F.array(*(F.struct(F.lit(n).alias("label"), known(e).alias("estimate"), known(m).alias("margin")) for n, (e, m) in measures.items()))
    return df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.label", "c.estimate", "c.margin")


def summed(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Estimates add; margins add as the root of their squares."""
    return long.groupBy(*by).agg(F.sum("estimate").alias("population"), F.sqrt(F.sum(F.col("margin") * F.col("margin"))).alias("margin_of_error"))


def acs_table(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """A pipe-delimited table of one geography level, GEO_ID without its prefix."""
    raw = spark.read.option("header", True).option("sep", "|").option("inferSchema", False).csv(path)
    return raw.where(F.startswith("GEO_ID", F.lit(prefix))).withColumn("geo_id", F.replace("GEO_ID", F.lit(prefix), F.lit("")))


def crude_prevalence(rows: DataFrame, kind: str = "CrdPrv") -> DataFrame:
    """County rows of crude prevalence only, named and typed."""
    return rows.where(F.col("datavaluetypeid") == kind).select(
        F.col("stateabbr").alias("state_code"), F.col("locationid").alias("county_fips"), F.col("locationname").alias("county_name"), F.col("measureid").alias("measure_id"), "measure",
        F.col("data_value").try_cast("double").alias("prevalence_pct"), F.col("low_confidence_limit").try_cast("double").alias("ci_low_pct"), F.col("high_confidence_limit").try_cast("double").alias("ci_high_pct"),
        F.regexp_replace("totalpop18plus", ",", "").try_cast("long").alias("adult_population"), F.col("year").try_cast("int").alias("data_year"),
    )


def registry_export(lines: DataFrame, programs: Mapping[str, str], least_fields: int = 9) -> DataFrame:
    """State rows of an export with a free-text head and notes: lines with enough fields and a five-digit code.

    A number that is suppressed becomes NULL; a bracketed footnote in the state's name tells the program.
    """
    parts = F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(least_fields))), {"sep": ","})
    rows = lines.where(F.length("value") - F.length(F.replace("value", F.lit(","), F.lit(""))) >= least_fields - 1).select(parts.alias("r")).where(F.trim("r.c1").rlike("^[0-9]{5}$") & (F.trim("r.c1") != "00000"))
    number = lambda c, kind: F.regexp_replace(F.col(c), "[^0-9.]", "").try_cast(kind)
    note = F.regexp_extract("r.c0", r"\(([0-9]+)\)\s*$", 1)
    named = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in programs.items() for x in kv)), note), F.lit("unknown"))
    return rows.select(
        F.substring(F.trim("r.c1"), 1, 2).alias("state_fips"), F.trim(F.regexp_replace("r.c0", r"\([0-9]+\)\s*$", "")).alias("state_name"), number("r.c2", "double").alias("age_adjusted_rate_per_100k"),
        number("r.c3", "double").alias("ci_low"), number("r.c4", "double").alias("ci_high"), number("r.c5", "long").alias("annual_cases"), named.alias("registry_program"),
    )


def shares(counts: DataFrame, by: str, value: str) -> DataFrame:
    """Sum of exclusive groups per label; a suppressed (NULL) count stops the job, for a share of an unknown total is none."""
    checked = F.when(F.col(value).isNull(), F.raise_error(F.concat(F.lit("suppressed count for "), F.col(by)))).otherwise(F.col(value))
    return counts.groupBy(by).agg(F.sum(checked).alias(value))


def dominant_group(df: DataFrame, key: str, group: str, weight: str, order: Sequence[str] | None = None) -> DataFrame:
    """The group of most weight per key and its share; ties go to the earlier group of ``order``, or to the lesser name."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(group)) if order else F.col(group)
    per = df.groupBy(key, group).agg(F.sum(weight).alias("w"))
    best = Window.partitionBy(key).orderBy(F.col("w").desc(), place)
    ranked = per.withColumn("rn", F.row_number().over(best)).withColumn("share", F.try_divide(F.col("w").cast("double"), F.sum("w").over(Window.partitionBy(key)).cast("double")))
    return ranked.where("rn = 1").select(key, group, "w", "share")


def county_context(counties: DataFrame, svi: DataFrame, tracts: DataFrame, order: Sequence[str]) -> DataFrame:
    """Counties with their vulnerability score (-999 is none) and their dominant rural-urban group."""
    score = svi.select("county_fips", F.when(F.col("rpl_themes") != -999, F.col("rpl_themes")).alias("svi_rpl_themes"))
    group = dominant_group(tracts, "county_fips", "ruca_group", "population", order)
    return counties.join(score, "county_fips", "left").join(group.select("county_fips", "ruca_group", F.col("share").alias("ruca_group_pop_share")), "county_fips", "left")


def rural_urban(code: Column) -> Column:
    """Metropolitan, micropolitan, small town or rural from a primary code of 1 to 10; NULL otherwise (99 is not coded)."""
    return F.when(code.between(1, 3), "metropolitan").when(code.between(4, 6), "micropolitan").when(code.between(7, 9), "small_town").when(code == 10, "rural")
