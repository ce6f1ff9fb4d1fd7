"""Staging, manifests, detail documents and extracts on the driver's tables, which stand in for a registry's by renamed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import nearest_within
from ..plans import dimensions, reports, staging
from ..registry import Tables, query
from ..sources import manifests

def provenance(key: str) -> list:
    return [F.lit("run").alias("ingestion_run_id"), F.lit("p").alias("indication_profile_id"), F.col(key).cast("string").alias("nct_id"), F.lit("h").alias("source_json_hash")]


@query("""SELECT s_suppkey::VARCHAR AS nct_id, s_nationkey::BIGINT AS location_ordinal, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS city_normalized, s_name AS city,
CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS latitude, s_acctbal > 0 AS usable_geography_flag, NULL::VARCHAR AS zip_code FROM supplier WHERE s_suppkey % 10 <> 9""")
def stg2_locations(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    raw = t.supplier.select(
        F.when(k % 10 != 9, k.cast("string")).alias("nct_id"), F.col("s_nationkey").cast("string").alias("location_ordinal"), F.col("s_name").alias("city"),
        F.when(k % 3 == 0, "north").otherwise(F.col("s_acctbal").cast("string")).alias("latitude"), (F.col("s_acctbal") > 0).cast("string").alias("usable_geography_flag"),
    )
    return staging.stage_locations(raw).select("nct_id", "location_ordinal", "city_normalized", "city", "latitude", "usable_geography_flag", "zip_code")


@query("""SELECT p_partkey::VARCHAR AS nct_id, p_type AS condition_group, CASE WHEN p_size < 10 THEN 'low' ELSE 'high' END AS mapping_confidence,
CASE WHEN p_partkey % 5 = 0 THEN 'given' WHEN p_size >= 10 AND p_brand <> 'Brand#1' THEN 'yaml_overlay' ELSE 'text_fallback' END AS mapping_source FROM part""")
def stg3_conditions(t: Tables) -> DataFrame:
    raw = t.part.select(
        *provenance("p_partkey"), F.when(F.col("p_brand") == "Brand#1", "unmapped").otherwise(F.col("p_type")).alias("condition_group"), "p_type",
        F.when(F.col("p_size") < 10, "low").otherwise("high").alias("mapping_confidence"), F.when(F.col("p_partkey") % 5 == 0, "given").alias("mapping_source"),
    )
    shown = staging.stage_conditions(raw).join(t.part.select(F.col("p_partkey").cast("string").alias("nct_id"), "p_type"), "nct_id")
    return shown.select("nct_id", F.col("p_type").alias("condition_group"), "mapping_confidence", "mapping_source")


@query("SELECT l_orderkey::VARCHAR AS nct_id, 'D' || l_partkey AS mesh_id, l_linenumber > 1 AS is_ancestor FROM lineitem")
def stg4_mesh(t: Tables) -> DataFrame:
    raw = t.lineitem.select(*provenance("l_orderkey"), F.concat(F.lit("D"), "l_partkey").alias("mesh_id"), (F.col("l_linenumber") > 1).cast("string").alias("is_ancestor"))
    return staging.stage_mesh(raw).select("nct_id", "mesh_id", "is_ancestor")


@query("""SELECT 'arm' AS entity, l_orderkey::VARCHAR AS nct_id, l_linenumber::BIGINT AS ordinal, l_partkey::VARCHAR AS label, NULL::VARCHAR AS kind FROM lineitem
UNION ALL SELECT 'outcome', l_orderkey::VARCHAR, l_linenumber, l_shipdate::DATE::VARCHAR, 'primary' FROM lineitem
UNION ALL SELECT 'sponsor', l_orderkey::VARCHAR, NULL, l_suppkey::VARCHAR, CASE WHEN l_linenumber = 1 THEN 'lead_sponsor' ELSE 'collaborator' END FROM lineitem
UNION ALL SELECT 'intervention', l_orderkey::VARCHAR, NULL, l_partkey::VARCHAR, l_returnflag FROM lineitem""")
def stg5_children(t: Tables) -> DataFrame:
    """The four child tables, staged from text columns."""
    n = F.col("l_linenumber")
    raw = t.lineitem.select(
        *provenance("l_orderkey"), n.cast("string").alias("arm_ordinal"), F.col("l_partkey").alias("arm_label"), n.cast("string").alias("outcome_index"), F.lit("primary").alias("outcome_type"),
        F.col("l_shipdate").cast("date").alias("outcome_measure"), F.col("l_suppkey").alias("sponsor_name"), F.when(n == 1, "lead_sponsor").otherwise("collaborator").alias("sponsor_role"),
        F.col("l_partkey").alias("intervention_name"), F.col("l_returnflag").alias("intervention_type"),
    )
    none = F.lit(None)
    shown = lambda df, name, ordinal, label, kind: df.select(F.lit(name).alias("entity"), "nct_id", ordinal.cast("long").alias("ordinal"), F.col(label).alias("label"), kind.cast("string").alias("kind"))
    rows = shown(staging.stage_arms(raw), "arm", F.col("arm_ordinal"), "arm_label", none)
    rows = rows.unionByName(shown(staging.stage_outcomes(raw), "outcome", F.col("outcome_index"), "outcome_measure", F.col("outcome_type")))
    rows = rows.unionByName(shown(staging.stage_sponsors(raw), "sponsor", none, "sponsor_name", F.col("sponsor_role")))
    return rows.unionByName(shown(staging.stage_interventions(raw), "intervention", none, "intervention_name", F.col("intervention_type")))


@query("""SELECT ts::DATE::VARCHAR AS ingestion_run_id, CASE WHEN day(ts::DATE) % 6 = 0 THEN 'failed' ELSE 'success' END AS status, min(ts)::DATE AS snapshot_date, count(*)::INTEGER AS record_count,
'p' || (day(ts::DATE) % 2) AS indication_profile_id, NULL::VARCHAR AS error FROM events GROUP BY ts::DATE""")
def stg8_snapshots(t: Tables) -> DataFrame:
    day = F.col("ts").cast("date")
    runs = t.events.groupBy(day.cast("string").alias("ingestion_run_id"), F.dayofmonth(day).alias("d")).agg(F.min("ts").alias("first"), F.count("*").cast("string").alias("record_count"))
    raw = runs.select(
        "ingestion_run_id", F.when(F.col("d") % 6 == 0, "failed").otherwise("success").alias("status"), F.concat(F.date_format("first", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("started_at_utc"),
        "record_count", F.concat(F.lit("p"), F.col("d") % 2).alias("profile"),
    )
    return staging.stage_snapshots(raw).select("ingestion_run_id", "status", "snapshot_date", "record_count", "indication_profile_id", "error")


@query("""WITH c AS (SELECT count(*) AS n, count(DISTINCT event_id) AS k, count(user_id) AS u, count(CASE WHEN value > 50 THEN value END) AS v FROM events)
SELECT unnest(['event_id', 'user_id', 'high']) AS column_name, n AS n_rows, k AS n_keys, unnest([k::DOUBLE / n, u::DOUBLE / n, v::DOUBLE / n]) AS filled_share, (SELECT count(*) FROM lineitem) AS n_expected, n = (SELECT count(*) FROM lineitem) AS reconciled FROM c""")
def qc3_reconciled_profile(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", F.when(F.col("value") > 50, F.col("value")).alias("high"))
    return manifests.reconciled_profile(rows, "event_id", t.lineitem.agg(F.count("*")))


@query("""WITH x AS (SELECT (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS n, (SELECT count(*) FROM orders) AS m, (SELECT count(*) - count(DISTINCT o_orderkey) FROM orders) AS d, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS r)
SELECT 'manifest' AS guard, m - d AS expected, n AS n_new FROM x WHERE n < m - d UNION ALL SELECT 'statistics', m, n FROM x WHERE n < m UNION ALL SELECT 'retained', r, n FROM x WHERE n < r""")
def flt19_rebuild_guards(t: Tables) -> DataFrame:
    """A rebuild that lost the orders in progress may not replace what is there."""
    records = t.orders.select(F.col("o_orderkey").alias("k"), F.md5(F.col("o_orderkey").cast("string")).alias("h"))
    stats = manifests.transform_stats(records, {"trials": t.orders, "lines": t.lineitem}, "r", "k", "h", 0).withColumn("manifest_count", F.col("n_records"))
    return manifests.guard_rebuild(t.orders.where("o_orderstatus <> 'P'"), stats, t.orders.where("o_orderstatus = 'O'"))


@query("""SELECT count(*) AS n_records, count(*) - count(DISTINCT o_orderkey) AS n_duplicates, (SELECT count(*) FROM lineitem) AS lines, (SELECT count(*) FROM orders) AS trials FROM orders""")
def snk2_transform_stats(t: Tables) -> DataFrame:
    records = t.orders.select(F.col("o_orderkey").alias("k"), F.md5(F.col("o_orderkey").cast("string")).alias("h"))
    stats = manifests.transform_stats(records, {"trials": t.orders, "lines": t.lineitem}, "r", "k", "h", 0)
    return stats.select("n_records", "n_duplicates", F.col("entity_rows")["lines"].alias("lines"), F.col("entity_rows")["trials"].alias("trials"))


@query("""WITH l AS (SELECT l_orderkey, list({'l_linenumber': l_linenumber::INTEGER, 'p_type': p_type} ORDER BY l_linenumber, p_type) AS lines FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
s AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_suppkey) AS sup FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) GROUP BY 1)
SELECT o_orderkey, o_orderstatus, coalesce(array_to_string(list_transform(lines, lambda x: x.l_linenumber || ':' || x.p_type), ','), '') AS lines, coalesce(array_to_string(sup, ','), '') AS suppliers
FROM orders LEFT JOIN l ON l.l_orderkey = o_orderkey LEFT JOIN s ON s.l_orderkey = o_orderkey""")
def qry2_detail_documents(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).withColumnRenamed("l_orderkey", "o_orderkey")
    suppliers = lines.select("o_orderkey", "l_suppkey").distinct()
    documents = reports.build_detail_documents(t.orders, "o_orderkey", {"lines": (lines, ["l_linenumber", "p_type"], ["l_linenumber", "p_type"]), "suppliers": (suppliers, ["l_suppkey"], ["l_suppkey"])})
    shown = lambda name, f: F.array_join(F.transform(name, f), ",").alias(name)
    return documents.select(
        "o_orderkey", "o_orderstatus", shown("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["p_type"])), shown("suppliers", lambda x: x["l_suppkey"].cast("string"))
    )


@query("""WITH s AS (SELECT l_orderkey, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS site_states, count(*) AS n_sites FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0 GROUP BY 1)
SELECT o_orderkey, o_orderstatus, site_states, coalesce(n_sites, 0) AS n_sites FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def qry11_explorer(t: Tables) -> DataFrame:
    sites = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).withColumnRenamed("l_orderkey", "o_orderkey")
    return reports.build_explorer(t.orders, "o_orderkey", sites, "n_name", F.col("s_acctbal") > 0).select("o_orderkey", "o_orderstatus", "site_states", "n_sites")


@query("""WITH o AS (SELECT user_id::VARCHAR AS nct_id, ts::DATE AS snapshot_date, upper(trim(event_type)) AS overall_status FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1),
h AS (SELECT *, lag(overall_status) OVER w AS previous_status, lag(snapshot_date) OVER w AS previous_date FROM o WINDOW w AS (PARTITION BY nct_id ORDER BY snapshot_date)),
n AS (SELECT h.nct_id, h.snapshot_date, h.overall_status, h.previous_status, h.previous_date IS NOT NULL AND h.overall_status IS DISTINCT FROM h.previous_status AS status_changed,
 h.previous_date IS NOT NULL AND h.overall_status = 'PURCHASE' AND h.previous_status <> 'PURCHASE' AS entered, h.previous_date IS NOT NULL AND h.overall_status <> 'PURCHASE' AND h.previous_status = 'PURCHASE' AS "left" FROM h),
m AS (SELECT n.nct_id, n.snapshot_date, min({'gap': abs(date_diff('day', n.snapshot_date, v.day)), 'd': v.day}) AS m FROM n JOIN (SELECT DISTINCT user_id::VARCHAR AS nct_id, ts::DATE AS day FROM events WHERE event_type = 'error') v ON v.nct_id = n.nct_id AND abs(date_diff('day', n.snapshot_date, v.day)) <= 3 GROUP BY 1, 2)
SELECT n.*, m.m.d AS other_day, (m.m.gap)::INTEGER AS gap FROM n LEFT JOIN m ON m.nct_id = n.nct_id AND m.snapshot_date = n.snapshot_date""")
def qry21_extract_history(t: Tables) -> DataFrame:
    """Dated extracts (each day's last event of a user) as a history, and the nearest day of another source within three days."""
    from .windowed import daily

    none = F.lit(None).cast("string")
    rows = daily(t).select(
        F.col("user_id").cast("string").alias("nct_id"), F.concat(F.lit(" "), F.lower("event_type")).alias("overall_status"), none.alias("start_date"), none.alias("primary_completion_date"),
        none.alias("completion_date"), F.col("day").alias("snapshot_date"),
    )
    found = manifests.extract_history(rows, "PURCHASE").select("nct_id", "snapshot_date", "overall_status", "previous_status", "status_changed", "entered", "left")
    other = t.events.where("event_type = 'error'").select(F.col("user_id").cast("string").alias("nct_id"), F.col("ts").cast("date").alias("other_day")).distinct()
    return nearest_within(found, other, "nct_id", "snapshot_date", "other_day", 3)


@query("""SELECT d AS date_day, year(d) AS year, quarter(d) AS quarter, month(d) AS month, strftime(d, '%Y-%m') AS year_month, date_trunc('month', d)::DATE AS month_start, date_trunc('quarter', d)::DATE AS quarter_start,
dayname(d) AS day_name, isodow(d) >= 6 AS is_weekend FROM (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)""")
def mrt19_dim_date(t: Tables) -> DataFrame:
    return dimensions.build_date_dimension(t.orders, "o_orderdate")
