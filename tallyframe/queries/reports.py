"""Reports that read the products, the registry grain, and the remaining checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import quality
from ..operators import relational as R
from ..operators.windows import beyond_newest, latest_per_key, status_history
from ..plans import dimensions
from ..plans import history as H
from ..plans import reports as plans
from ..registry import QUERIES, Tables, query
from .windowed import DAILY_SQL, HISTORY_SQL, daily, history


def product(t: Tables, name: str) -> DataFrame:
    return QUERIES[name](t.spark, t.sf_dir)


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal IS NOT NULL AND s_nationkey IS NOT NULL AND s_nationkey <> 7 AND s_acctbal > 0")
def fil2_usable_geography(t: Tables) -> DataFrame:
    return t.supplier.where("s_acctbal IS NOT NULL AND s_nationkey IS NOT NULL AND s_nationkey <> 7 AND s_acctbal > 0").select("s_suppkey")


@query(f"WITH {HISTORY_SQL} SELECT user_id FROM history WHERE event_type IN ('purchase', 'click') AND day = (SELECT max(day) FROM history) AND user_id % 4 IN (1, 2)")
def fil4_open_sites(t: Tables) -> DataFrame:
    return R.at_latest(history(t), "day").where(F.col("event_type").isin("purchase", "click") & (F.col("user_id") % 4).isin(1, 2)).select("user_id")


@query("SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY','PROMO') AND (contains(lower(p_name), 'bolt') OR contains(p_partkey::VARCHAR, '77')) AND p_brand NOT IN ('Brand#1')")
def fil12_segment_filters(t: Tables) -> DataFrame:
    named = R.any_of(R.contains_text(F.col("p_name"), "BOLT"), F.contains(F.col("p_partkey").cast("string"), F.lit("77")))
    return t.part.where(F.col("p_type").isin("ECONOMY", "PROMO") & named & ~F.col("p_brand").isin("Brand#1")).select("p_partkey")


@query("SELECT n_nationkey, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AS has_rich FROM nation")
def join13_exists_flag(t: Tables) -> DataFrame:
    rich = t.customer.where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey")).distinct().withColumn("has_rich", F.lit(True))
    return t.nation.join(rich, "n_nationkey", "left").select("n_nationkey", F.coalesce("has_rich", F.lit(False)).alias("has_rich"))


@query(f"WITH {DAILY_SQL}, d AS (SELECT user_id % 5 AS k, day, max(event_type) AS s FROM daily GROUP BY 1, 2), p AS (SELECT *, lag(s) OVER (PARTITION BY k ORDER BY day) AS b FROM d) SELECT k, day, b AS before_value, s AS after_value FROM p WHERE b IS NOT NULL AND b <> s")
def join11_consecutive_snapshots(t: Tables) -> DataFrame:
    d = daily(t).groupBy((F.col("user_id") % 5).alias("k"), "day").agg(F.max("event_type").alias("s"))
    runs = d.select("k", "day").withColumn("previous", F.lag("day").over(Window.partitionBy("k").orderBy("day")))
    old = d.select("k", F.col("day").alias("previous"), F.col("s").alias("before_value"))
    return d.join(runs, ["k", "day"]).join(old, ["k", "previous"]).where("s <> before_value").select("k", "day", "before_value", F.col("s").alias("after_value"))


@query("SELECT o_orderkey, coalesce(d, '') AS shown FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders WHERE o_totalprice > 450000) ORDER BY coalesce(d, '') DESC, o_orderkey LIMIT 50")
def qry4_live_sort(t: Tables) -> DataFrame:
    shown = F.coalesce(F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit(""))
    return t.orders.where("o_totalprice > 450000").select("o_orderkey", shown.alias("shown")).orderBy(F.col("shown").desc(), "o_orderkey").limit(50)


@query("SELECT c_custkey, s.lat, s.lon FROM customer LEFT JOIN (SELECT s_nationkey, round(avg(s_suppkey), 6) AS lat, round(avg(s_acctbal), 6) AS lon FROM supplier GROUP BY 1) s ON s_nationkey = c_nationkey")
def qry5_postal_centroid(t: Tables) -> DataFrame:
    centre = t.supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.round(F.avg("s_suppkey"), 6).alias("lat"), F.round(F.avg("s_acctbal"), 6).alias("lon"))
    return t.customer.join(centre, "c_nationkey", "left").select("c_custkey", "lat", "lon")


@query("""WITH l AS (SELECT l_orderkey, list_sort(list_distinct(list(p_type))) AS groups, list_sort(list_distinct(list(s_nationkey))) AS states, count(DISTINCT l_suppkey) AS sponsors FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
SELECT o_orderkey, array_to_string(groups, '|') AS groups, array_to_string(states, '|') AS states, coalesce(sponsors, 0) AS sponsors, CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice <= 300000 THEN 'medium' ELSE 'large' END AS band FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def mrt8_comparability_features(t: Tables) -> DataFrame:
    from ..functions.numbers import banded

    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).withColumnRenamed("l_orderkey", "o_orderkey")
    band = F.when(F.col("o_totalprice") < 100000, "small").otherwise(banded(F.col("o_totalprice"), ((300000, "medium"),), "large", inclusive=True))
    out = dimensions.build_comparability(t.orders, rows, "o_orderkey", {"g": "p_type", "s": "s_nationkey"}, {"sponsors": "l_suppkey"}, band)
    return out.select("o_orderkey", F.array_join("g", "|").alias("groups"), F.array_join("s", "|").alias("states"), "sponsors", "band")


@query("SELECT l_orderkey, l_linenumber, n_name, l_shipdate IS NULL OR l_shipdate < o_orderdate AS suspicious FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey WHERE o_orderstatus <> 'P'")
def mrt39_location_audit(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders.where("o_orderstatus <> 'P'"), F.col("o_orderkey") == F.col("l_orderkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    suspicious = F.col("l_shipdate").isNull() | (F.col("l_shipdate") < F.col("o_orderdate"))
    return dimensions.build_location_audit(rows, t.nation, "s_nationkey", "n_nationkey", ["l_orderkey", "l_linenumber", "n_name"], suspicious)


REGISTRY_SQL = """runs AS (SELECT day FROM (SELECT ts::DATE AS day, count(*) FILTER (WHERE event_type = 'error') AS bad FROM events GROUP BY 1) WHERE day(day) % 5 <> 0),
obs AS (SELECT user_id, day, event_type FROM (SELECT user_id, ts::DATE AS day, event_type, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts::DATE IN (SELECT day FROM runs)) WHERE rn = 1)"""


def registry_observations(t: Tables) -> DataFrame:
    """Observations of complete runs only: every fifth day stands for a run that failed."""
    return daily(t).where(F.dayofmonth("day") % 5 != 0)


@query(f"WITH {REGISTRY_SQL}, h AS (SELECT *, lag(event_type) OVER w AS previous_status, lag(day) OVER w AS previous_date FROM obs WINDOW w AS (PARTITION BY user_id ORDER BY day)) SELECT user_id, day, event_type, previous_status, previous_date FROM h")
def mrt1_registry_history(t: Tables) -> DataFrame:
    return status_history(registry_observations(t), ["user_id"], "day", "event_type", "purchase").select("user_id", "day", "event_type", "previous_status", "previous_date")


@query(f"WITH {REGISTRY_SQL} SELECT user_id, day, event_type, day = (SELECT max(day) FROM runs) AS is_active_in_latest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS rn FROM obs) WHERE rn = 1")
def mrt2_registry_current(t: Tables) -> DataFrame:
    return H.current_status(registry_observations(t), ["user_id"], "day").select("user_id", "day", "event_type", "is_active_in_latest")


@query(f"WITH {REGISTRY_SQL} SELECT day, event_type, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (WHERE user_id % 2 = 0) AS relevant FROM obs GROUP BY 1, 2")
def mrt25_registry_activity(t: Tables) -> DataFrame:
    return R.distinct_where(registry_observations(t), ["day", "event_type"], "user_id", {"users": F.lit(True), "relevant": F.col("user_id") % 2 == 0})


@query(f"""WITH {HISTORY_SQL}, a AS (SELECT user_id % 3 AS grp, day, count(DISTINCT user_id) AS n FROM history WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT grp, day, n FROM a WHERE grp IN (0, 2) AND day = (SELECT max(day) FROM a) ORDER BY n DESC, grp""")
def qry13_scoped_read(t: Tables) -> DataFrame:
    per = plans.build_scoped_counts(history(t), F.col("event_type") == "purchase", F.col("user_id") % 3, "grp", "day", "user_id")
    return R.at_latest(per, "day").where(F.col("grp").isin(0, 2)).select("grp", "day", "n").orderBy(F.col("n").desc(), "grp")


@query("""SELECT ts::DATE AS day, round(avg((event_type = 'error')::INT), 8) AS error_share, round(avg((event_type = 'error')::INT) - lag(avg((event_type = 'error')::INT)) OVER (ORDER BY ts::DATE), 8) AS change FROM events GROUP BY 1""")
def qry14_reliability_trend(t: Tables) -> DataFrame:
    return plans.build_reliability_trend(t.events, F.col("ts").cast("date"), "day", F.col("event_type") == "error", "error_share")


@query(f"""WITH {HISTORY_SQL} SELECT user_id, day, event_type, CASE WHEN entered THEN 'entered' WHEN "left" THEN 'left' WHEN event_type = 'purchase' THEN 'active' END AS metric, previous_date FROM history WHERE (entered OR "left" OR event_type = 'purchase') AND day >= (SELECT max(day) - 7 FROM history)""")
def qry16_audit_observations(t: Tables) -> DataFrame:
    metrics = {"entered": F.col("entered"), "left": F.col("left"), "active": F.col("event_type") == "purchase"}
    return plans.build_audit_observations(history(t), "day", 7, metrics, ["user_id", "day", "event_type", "metric", "previous_date"])


@query("""SELECT node, area, per_100k AS shown, 'per_100k' AS unit FROM (SELECT c_nationkey AS area, o_orderpriority AS node, round(count(DISTINCT o_orderkey)::DOUBLE / p.population * 100000, 4) AS per_100k FROM orders JOIN customer ON c_custkey = o_custkey JOIN (SELECT c_nationkey AS k, count(*) AS population FROM customer GROUP BY 1) p ON p.k = c_nationkey GROUP BY 1, 2, p.population) WHERE area NOT IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) >= 4)
UNION ALL SELECT o_orderpriority, c_nationkey, round(count(DISTINCT o_orderkey)::DOUBLE / s.cases * 1000, 4), 'per_1k_cases' FROM orders JOIN customer ON c_custkey = o_custkey JOIN (SELECT s_nationkey AS k, count(*) AS cases FROM supplier GROUP BY 1 HAVING count(*) >= 4) s ON s.k = c_nationkey GROUP BY 1, 2, s.cases""")
def qry19_rate_view(t: Tables) -> DataFrame:
    return plans.build_rate_view(product(t, "mrt30_access_rates"), ["node", "area"], F.col("denominator_available"), "per_1k_cases", "per_100k")


@query("""WITH d AS (SELECT c_nationkey AS region, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'status' WHEN c_acctbal < 0 THEN 'balance' ELSE 'included' END AS category FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT region, category, count(*) AS n, min(o_orderkey) AS sample_key, sum(count(*)) OVER (PARTITION BY region)::BIGINT AS region_total FROM d GROUP BY 1, 2""")
def qry22_national_case_study(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    category = F.when(F.col("o_orderstatus") == "P", "status").when(F.col("c_acctbal") < 0, "balance").otherwise("included")
    return plans.build_case_study(rows, F.col("c_nationkey"), "region", category, "o_orderkey")


@query("""SELECT (SELECT max(ts)::DATE FROM events) AS latest_run, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lines, (SELECT count(*) FROM customer) > 0 AND (SELECT count(*) FROM lineitem WHERE l_orderkey IS NULL) = 0 AS all_passed""")
def qc7_publication_capture(t: Tables) -> DataFrame:
    e = t.events.agg(F.max("ts").cast("date").alias("latest_run"))
    o, line = t.orders.agg(F.count("*").alias("orders")), t.lineitem.agg(F.count("*").alias("lines"), F.count_if(F.col("l_orderkey").isNull()).alias("bad"))
    c = t.customer.agg(F.count("*").alias("customers"))
    one = e.crossJoin(F.broadcast(o)).crossJoin(F.broadcast(line)).crossJoin(F.broadcast(c))  # one row each
    return one.select("latest_run", "orders", "lines", ((F.col("customers") > 0) & (F.col("bad") == 0)).alias("all_passed"))


@query("""WITH r AS (SELECT user_id % 3 AS profile, ts::DATE AS day, count(*) AS n, count(DISTINCT event_id) AS m FROM events WHERE event_type <> 'error' GROUP BY 1, 2) SELECT profile, day, n = m AS intact FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY day DESC) AS rn FROM r) WHERE rn = 1""")
def qc8_manifest_integrity(t: Tables) -> DataFrame:
    runs = t.events.where("event_type <> 'error'").groupBy((F.col("user_id") % 3).alias("profile"), F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("m"))
    return latest_per_key(runs, ["profile"], F.col("day").desc()).select("profile", "day", (F.col("n") == F.col("m")).alias("intact"))


@query(f"""WITH {HISTORY_SQL} SELECT 'one_current_row' AS "check", user_id || '|' || day AS item FROM history GROUP BY user_id, day HAVING count(*) > 1
UNION ALL SELECT 'entered_needs_predecessor', user_id || '|' || day FROM history WHERE entered AND previous_date IS NULL
UNION ALL SELECT 'start_before_completion', l_orderkey || '|' || l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate
UNION ALL SELECT 'valid_state', n_nationkey::VARCHAR FROM nation WHERE NOT regexp_matches(n_name, '^[A-Z_]+[0-4]$')""")
def qc6_integrity_checks(t: Tables) -> DataFrame:
    rows = history(t)
    key = F.concat_ws("|", "user_id", "day")
    repeated = rows.groupBy("user_id", "day").agg(F.count("*").alias("n"))
    lines = R.dealt_join(t.lineitem, t.orders, "l_orderkey", "o_orderkey", R.parts(t.lineitem))
    return quality.together(
        quality.violations("one_current_row", repeated, F.col("n") > 1, key), quality.violations("entered_needs_predecessor", rows, F.col("entered") & F.col("previous_date").isNull(), key),
        quality.violations("start_before_completion", lines, F.col("l_shipdate") < F.col("o_orderdate"), F.concat_ws("|", "l_orderkey", "l_linenumber")),
        quality.violations("valid_state", t.nation, ~F.col("n_name").rlike("^[A-Z_]+[0-4]$"), F.col("n_nationkey")),
    )


@query("SELECT user_id, day FROM (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS rn FROM (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type <> 'error')) WHERE rn > 3")
def srt5_runs_to_prune(t: Tables) -> DataFrame:
    good = t.events.where("event_type <> 'error'").select("user_id", F.col("ts").cast("date").alias("day")).distinct()
    return beyond_newest(good, ["user_id"], "day", 3)
