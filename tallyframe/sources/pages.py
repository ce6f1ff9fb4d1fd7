"""Paged JSON with provenance: pages to records, screening into good rows and quarantine, the flattened entities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_pages(spark: SparkSession, path: str, schema: StructType, records: str = "studies") -> DataFrame:
    """One row per record: the record, its page's file name and its place on the page (from 0).

    ``retrieved_at_utc`` comes from the sidecar of the same page name and is NULL where there is none.
    """
    pages = spark.read.schema(schema).option("multiLine", True).json(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = pages.select(name.alias("raw_page_reference"), F.posexplode(records).alias("raw_ordinal", "record"))
    return rows.withColumn("raw_ordinal", F.col("raw_ordinal").cast("long"))


def with_sidecar(rows: DataFrame, sidecars: DataFrame) -> DataFrame:
    return rows.join(sidecars.select("raw_page_reference", "retrieved_at_utc"), "raw_page_reference", "left")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    meta = spark.read.schema("retrieved_at_utc string").option("multiLine", True).json(path)
    return meta.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("raw_page_reference"), "retrieved_at_utc")


def screen(rows: DataFrame, is_object: Column, key: Column, pattern: str) -> DataFrame:
    """``reason`` is NULL for good records, else why they go to quarantine."""
    reason = (
        F.when(~F.coalesce(is_object, F.lit(False)), "NOT_AN_OBJECT").when(key.isNull() | (F.trim(key) == ""), "MISSING_ID")
        .when(~key.rlike(pattern), "INVALID_ID_FORMAT")
    )
    return rows.withColumn("reason", reason)


def split_quarantine(screened: DataFrame) -> tuple[DataFrame, DataFrame]:
    return screened.where(F.col("reason").isNull()).drop("reason"), screened.where(F.col("reason").isNotNull())


def entity(rows: DataFrame, keys: Sequence[str], list_column: str, fields: Mapping[str, str], ordinal: str | None = None) -> DataFrame:
    """One row per element of a list of structs; ``fields`` maps output names to paths inside an element."""
    if ordinal:
        laid = rows.select(*keys, F.posexplode(list_column).alias(ordinal, "_e")).withColumn(ordinal, F.col(ordinal).cast("long"))
    else:
        laid = rows.select(*keys, F.explode(list_column).alias("_e"))
    return laid.select(*keys, *([ordinal] if ordinal else []), *(F.col(f"_e.{path}").alias(name) for name, path in fields.items()))


def direct_and_ancestor(rows: DataFrame, keys: Sequence[str], direct: str, ancestors: str) -> DataFrame:
    """Terms of both lists (structs of id and term), an id once per key: direct before ancestor, then list order."""
    flagged = F.concat(
        F.transform(F.coalesce(direct, F.array()), lambda m, i: F.struct(F.lit(False).alias("is_ancestor"), i.alias("pos"), m["id"].alias("id"), m["term"].alias("term"))),
        F.transform(F.coalesce(ancestors, F.array()), lambda m, i: F.struct(F.lit(True).alias("is_ancestor"), i.alias("pos"), m["id"].alias("id"), m["term"].alias("term"))),
    )
    laid = rows.select(*keys, F.explode(flagged).alias("m")).where("m.id is not null and m.term is not null")
    best = laid.groupBy(*keys, F.col("m.id").alias("mesh_id")).agg(F.min("m").alias("m"))
    return best.select(*keys, "mesh_id", F.col("m.term").alias("mesh_term"), F.col("m.is_ancestor").alias("is_ancestor"))


def terms_once(direct: str, ancestors: str) -> Column:
    """The terms of both lists of one row (structs of id and term), an id once: direct before ancestor, then list order."""
    flagged = lambda c, up: F.transform(F.coalesce(F.col(c), F.array()), lambda m: F.struct(m["id"].alias("id"), m["term"].alias("term"), F.lit(up).alias("is_ancestor")))
    every = F.filter(F.concat(flagged(direct, False), flagged(ancestors, True)), lambda m: m["id"].isNotNull() & m["term"].isNotNull())
    ids = F.transform(every, lambda m: m["id"])
    return F.filter(every, lambda m, i: F.array_position(ids, m["id"]) == i + 1)


def first_per_key(rows: DataFrame, key: str, content_hash: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key; a key with different contents stops the job; rows without a key are left out."""
    known = rows.where(F.col(key).isNotNull())
    # keys, places and hashes are grouped; the rows themselves are then picked by key and place
    per = known.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"), F.min(content_hash).alias("_low"), F.max(content_hash).alias("_high"))
    clash = F.when(F.col("_low") != F.col("_high"), F.raise_error(F.concat(F.lit("records differ for "), F.col(key).cast("string"))))
    first = per.withColumn("_ok", clash).where(F.col("_ok").isNull()).select(key, *(F.col(f"_first.{c}").alias(f"_{c}") for c in order))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in order]
    picked = known.join(first, [key]).where(reduce(and_, same)).drop(*(f"_{c}" for c in order))
    return picked.select(*known.columns)


def repeated_keys(rows: DataFrame, key: str, content_hash: str, order: Sequence[str]) -> DataFrame:
    """Keys of more than one row with the place of their first, as a struct ``_first``; different contents stop the job."""
    per = rows.groupBy(key).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"), F.min(content_hash).alias("_low"), F.max(content_hash).alias("_high")).where("_n > 1")
    clash = F.when(F.col("_low") != F.col("_high"), F.raise_error(F.concat(F.lit("records differ for "), F.col(key).cast("string"))))
    return per.withColumn("_ok", clash).where(F.col("_ok").isNull()).select(key, "_first")


def without_later(rows: DataFrame, repeated: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``rows`` less those after the first of ``repeated``, a written table: few keys repeat, so Catalyst may broadcast it by its size."""
    joined = rows.join(repeated, key, "left")
    return joined.where(F.col("_first").isNull() | (F.struct(*order) == F.col("_first"))).select(*rows.columns)


def dedup_stats(rows: DataFrame, key: str, content_hash: str) -> DataFrame:
    """One row: records, without key, duplicates of the same content, keys whose contents differ."""
    per = rows.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(content_hash).alias("h"))
    known = F.col(key).isNotNull()
    return per.agg(
        F.sum("n").alias("n_records"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_missing"),
        F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("n_duplicates"), F.count_if(known & (F.col("h") > 1)).alias("n_conflicts"),
    )


def demographics(rows: DataFrame, keys: Sequence[str], module: str = "baseline") -> DataFrame:
    """Measures x classes x categories x measurements, with the most specific denominator.

    ``module`` is a struct of denoms, groups and measures. A category without measurements keeps one row of NULLs.
    Denominators come from the class, else the measure, else the module; those that count participants come first.
    """
    m = rows.select(*keys, F.col(f"{module}.denoms").alias("_d0"), F.col(f"{module}.groups").alias("_groups"), F.posexplode(f"{module}.measures").alias("measure_index", "_m"))
    c = m.select("*", F.posexplode_outer("_m.classes").alias("class_index", "_c"))
    g = c.select("*", F.posexplode_outer("_c.categories").alias("category_index", "_g"))
    v = g.select("*", F.explode_outer("_g.measurements").alias("_v"))

    def chosen(denoms: Column) -> Column:
        people = F.filter(denoms, lambda d: F.lower(d["units"]).contains("participant"))
        return F.when(F.size(people) > 0, people[0]).when(F.size(denoms) > 0, denoms[0])

    units = F.coalesce(chosen(F.col("_c.denoms")), chosen(F.col("_m.denoms")), chosen(F.col("_d0")))
    count = F.filter(units["counts"], lambda x: x["groupId"] == F.col("_v.groupId"))
    title = F.filter("_groups", lambda x: x["id"] == F.col("_v.groupId"))
    first = lambda a, f: F.when(F.size(a) > 0, F.get(a, F.lit(0))[f])
    return v.select(
        *keys, F.col("measure_index").cast("long").alias("measure_index"), F.col("_m.title").alias("measure_title"), F.col("_m.paramType").alias("param_type"), F.col("_m.unitOfMeasure").alias("unit_of_measure"),
        F.col("class_index").cast("long").alias("class_index"), F.col("_c.title").alias("class_title"), F.col("category_index").cast("long").alias("category_index"), F.col("_g.title").alias("category_title"),
        F.col("_v.groupId").alias("group_id"), first(title, "title").alias("group_title"), first(count, "value").try_cast("long").alias("group_denominator"), F.col("_v.value").alias("value_raw"), F.col("_v.spread").alias("value_spread"),
    )
