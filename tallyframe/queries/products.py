"""Data products on the driver's tables: users stand for records, days for snapshots, purchases for the active status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import safe_divide
from ..operators import relational as R
from ..plans import access, dimensions, history as H, reports, similarity
from ..registry import Tables, query
from .windowed import DAILY_SQL, HISTORY_SQL, daily, history


@query(f"WITH {HISTORY_SQL} SELECT user_id, day, event_type, day = (SELECT max(day) FROM history) AS is_active_in_latest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS rn FROM history) WHERE rn = 1")
def mrt2_current_status(t: Tables) -> DataFrame:
    return H.current_status(history(t), ["user_id"], "day").select("user_id", "day", "event_type", "is_active_in_latest")


@query("""SELECT c_nationkey, p_type, o_orderpriority, count(DISTINCT o_orderkey) AS orders, count(DISTINCT o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS open, count(DISTINCT o_orderkey) FILTER (WHERE l_returnflag = 'R') AS returned
FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3""")
def mrt5_25_segment_activity(t: Tables) -> DataFrame:
    lines, orders = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")), t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    rows = R.dealt_join(lines, orders, "l_orderkey", "o_orderkey", R.parts(t.lineitem))
    return R.distinct_where(rows, ["c_nationkey", "p_type", "o_orderpriority"], "o_orderkey", {"orders": F.lit(True), "open": F.col("o_orderstatus") == "O", "returned": F.col("l_returnflag") == "R"})


@query("""WITH a AS (SELECT DISTINCT s_nationkey, p_type, s_suppkey, o_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'O'),
w AS (SELECT s_nationkey, p_type, s_suppkey, count(DISTINCT o_orderkey) AS w FROM a GROUP BY 1, 2, 3), s AS (SELECT *, w::DOUBLE / sum(w) OVER (PARTITION BY s_nationkey, p_type) AS share FROM w)
SELECT s_nationkey, p_type, count(s_suppkey) AS owners, round(CASE WHEN count(s_suppkey) >= 3 THEN sum(share * share) END, 8) AS hhi, round(max(share), 8) AS top_share FROM s GROUP BY 1, 2""")
def mrt7_sponsor_concentration(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    rows = R.dealt_join(lines, t.orders.where("o_orderstatus = 'O'"), "l_orderkey", "o_orderkey", R.parts(t.lineitem))
    rows = rows.select("s_nationkey", "p_type", "s_suppkey", "o_orderkey").distinct()
    return R.concentration(rows, ["s_nationkey", "p_type"], "s_suppkey", F.count("*")).select("s_nationkey", "p_type", "owners", F.round("hhi", 8).alias("hhi"), F.round("top_share", 8).alias("top_share"))


WEIGHTS = {"type": 0.3, "brand": 0.25, "size": 0.2, "price": 0.15, "suppliers": 0.1}


@query("""WITH s AS (SELECT l_partkey, list_distinct(list(l_suppkey)) AS sup FROM lineitem GROUP BY 1),
f AS (SELECT p_partkey AS k, p_type, p_brand, p_size // 10 AS size_band, floor(p_retailprice / 200) AS price_band, coalesce(sup, []) AS sup, p_type || '|' || p_size AS tok FROM part LEFT JOIN s ON l_partkey = p_partkey),
u AS (SELECT tok FROM f GROUP BY 1 HAVING count(*) < 2000), c AS (SELECT DISTINCT x.k AS a, y.k AS b FROM f x JOIN f y USING (tok) JOIN u USING (tok) WHERE x.k <> y.k),
r AS (SELECT c.a, c.b, round(CASE WHEN x.p_type = y.p_type THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN x.p_brand = y.p_brand THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN x.size_band = y.size_band THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN x.price_band = y.price_band THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN list_has_any(x.sup, y.sup) THEN 0.1::DOUBLE ELSE 0 END, 4) AS score,
concat_ws('; ', CASE WHEN x.p_type = y.p_type THEN 'type' END, CASE WHEN x.p_brand = y.p_brand THEN 'brand' END, CASE WHEN x.size_band = y.size_band THEN 'size' END, CASE WHEN x.price_band = y.price_band THEN 'price' END, CASE WHEN list_has_any(x.sup, y.sup) THEN 'suppliers' END) AS shared FROM c JOIN f x ON x.k = c.a JOIN f y ON y.k = c.b)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b)::INTEGER AS rank FROM r) WHERE rank <= 5""")
def mrt9_10_similarity_top_k(t: Tables) -> DataFrame:
    sup = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set("l_suppkey").alias("sup"))
    f = t.part.join(sup, "p_partkey", "left").select(F.col("p_partkey").alias("k"), "p_type", "p_brand", F.floor(F.col("p_size") / 10).alias("size_band"), F.floor(F.col("p_retailprice") / 200).alias("price_band"), F.coalesce("sup", F.array().cast("array<long>")).alias("sup"), F.concat_ws("|", "p_type", "p_size").alias("tok"))
    pairs = R.mirrored(R.pairs_by_token(f, "k", "tok", 2000))
    same = lambda c: F.col(f"a_{c}") == F.col(f"b_{c}")
    factors = {"type": same("p_type"), "brand": same("p_brand"), "size": same("size_band"), "price": same("price_band"), "suppliers": F.arrays_overlap("a_sup", "b_sup")}
    return similarity.top_matches(similarity.scored_pairs(pairs, f.drop("tok"), "k", factors, WEIGHTS), 5)


@query("""WITH r AS (SELECT ts::DATE AS day, count(*) AS n, min(ts) AS started, max(CASE WHEN user_id % 7 = 0 THEN NULL ELSE ts END) AS fetched, CASE WHEN day(ts::DATE) % 6 = 0 THEN 'failed' ELSE 'success' END AS status FROM events GROUP BY 1)
SELECT day, lag(day) OVER (ORDER BY day) AS previous_run FROM r WHERE status = 'success' AND (fetched IS NULL OR fetched >= started)""")
def mrt11_trusted_runs(t: Tables) -> DataFrame:
    day = F.col("ts").cast("date")
    runs = t.events.groupBy(day.alias("day")).agg(F.min("ts").alias("started"), F.max(F.when(F.col("user_id") % 7 != 0, F.col("ts"))).alias("fetched")).withColumn("status", F.when(F.dayofmonth("day") % 6 == 0, "failed").otherwise("success"))
    return H.trusted_runs(runs, "day", "day", "status", "started", "fetched").select("day", "previous_run")


@query("""WITH o AS (SELECT user_id, day, event_type, floor(value / 50)::INTEGER AS band, value > 90 AS top FROM (SELECT *, ts::DATE AS day, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1),
r AS (SELECT day, lag(day) OVER (ORDER BY day) AS previous_run FROM (SELECT DISTINCT day FROM o)),
p AS (SELECT n.*, r.previous_run, b.event_type AS o_type, b.band AS o_band, b.top AS o_top FROM o n JOIN r USING (day) JOIN o b ON b.user_id = n.user_id AND b.day = r.previous_run),
e AS (SELECT user_id, day, previous_run, 'status' AS field, o_type AS old_value, event_type AS new_value FROM p WHERE o_type IS DISTINCT FROM event_type UNION ALL
SELECT user_id, day, previous_run, 'enrolment', o_band || '|' || o_top, band || '|' || top FROM p WHERE o_band IS DISTINCT FROM band OR o_top IS DISTINCT FROM top)
SELECT md5(user_id || '||' || day || '||' || field) AS event_key, * FROM e""")
def mrt13_change_events(t: Tables) -> DataFrame:
    rows = t.events.withColumn("day", F.col("ts").cast("date"))
    last = rows.groupBy("user_id", "day").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("m"))
    observed = last.select("user_id", "day", F.col("m.event_type").alias("event_type"), F.floor(F.col("m.value") / 50).alias("band"), (F.col("m.value") > 90).alias("top"))
    from pyspark.sql import Window

    runs = observed.select("day").distinct().withColumn("previous_run", F.lag("day").over(Window.orderBy("day")))  # one row per run
    return H.change_events(observed, ["user_id"], "day", runs, {"status": ["event_type"], "enrolment": ["band", "top"]})


@query("SELECT 'group:' || replace(lower(p_type), ' ', '-') AS node, count(DISTINCT p_partkey) AS n, false AS is_ancestor_only FROM part GROUP BY 1 UNION ALL SELECT p_brand, count(DISTINCT p_partkey), bool_and(p_size > 25) FROM part GROUP BY 1")
def mrt15_20_condition_nodes(t: Tables) -> DataFrame:
    bridge = dimensions.build_condition_bridge(t.part, ["p_partkey"], F.col("p_type"), F.col("p_brand"), F.col("p_size") > 25)
    return dimensions.build_condition_dimension(bridge, "p_partkey")


@query("SELECT s_nationkey, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT s_suppkey) FILTER (WHERE l_linenumber = 1) AS leads, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def mrt16_17_dimension_counts(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    suppliers = dimensions.build_sponsor_dimension(rows, ["s_nationkey"], "s_suppkey", F.col("l_linenumber") == 1, ("suppliers", "leads"))
    return suppliers.join(dimensions.build_geography_dimension(rows, ["s_nationkey"], "l_orderkey", "orders"), "s_nationkey")


@query("""WITH p(preset, term) AS (VALUES ('a', 'promo brushed tin'), ('a', 'standard polished brass'), ('b', (SELECT lower(trim(min(p_type))) FROM part)), ('b', (SELECT lower(trim(max(p_type))) FROM part))),
m AS (SELECT DISTINCT preset, p_partkey FROM part JOIN p ON lower(trim(p_type)) = term) SELECT preset, p_partkey FROM m UNION ALL SELECT 'unassigned', p_partkey FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM m)""")
def mrt22_membership_unassigned(t: Tables) -> DataFrame:
    ends = t.part.agg(F.array(F.min("p_type"), F.max("p_type")).alias("x")).select(F.lit("b").alias("preset"), F.explode("x").alias("term"))
    terms = t.spark.createDataFrame([("a", "promo brushed tin"), ("a", "standard polished brass")], "preset string, term string").unionByName(ends)
    return dimensions.build_membership(t.part, "p_partkey", F.col("p_type"), terms)


@query(f"""WITH {HISTORY_SQL}, n AS (SELECT user_id, ts::DATE AS day, count(*) AS n_events, count(DISTINCT event_type) AS n_types FROM events GROUP BY 1, 2)
SELECT md5(user_id || '||' || day) AS fact_key, user_id, day, event_type, n_events, n_types, day = max(day) OVER (PARTITION BY user_id) AS is_current FROM history JOIN n USING (user_id, day)""")
def mrt23_snapshot_fact(t: Tables) -> DataFrame:
    n = t.events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n_events"), F.countDistinct("event_type").alias("n_types"))
    return dimensions.build_snapshot_fact(history(t), ["user_id"], "day", n, ["event_type"])


def activity(t: Tables) -> DataFrame:
    """Purchases of the daily history in segments made of the user's key."""
    k = F.col("user_id")
    return history(t).where("event_type = 'purchase'").withColumn("scope", F.pmod(k, F.lit(2))).withColumn("grp", F.pmod(k, F.lit(3))).withColumn("state", F.pmod(k, F.lit(5)))


@query(f"""WITH {HISTORY_SQL}, a AS (SELECT *, user_id % 2 AS scope, user_id % 3 AS grp, user_id % 5 AS state FROM history WHERE event_type = 'purchase'),
c AS (SELECT scope, day, date_diff('day', min(day) OVER (PARTITION BY scope), day) AS history_days, lag(day) OVER (PARTITION BY scope ORDER BY day) AS prev,
 first_value(day) OVER (PARTITION BY scope ORDER BY day RANGE BETWEEN INTERVAL 5 DAYS PRECEDING AND CURRENT ROW) AS f5, first_value(day) OVER (PARTITION BY scope ORDER BY day RANGE BETWEEN INTERVAL 10 DAYS PRECEDING AND CURRENT ROW) AS f10 FROM (SELECT DISTINCT user_id % 2 AS scope, day FROM history)),
s AS (SELECT scope, grp, state, day, count(DISTINCT user_id) AS active_count, count(DISTINCT user_id) FILTER (WHERE entered) AS entered_count, min(previous_date) FILTER (WHERE entered) AS pred FROM a GROUP BY 1, 2, 3, 4),
w AS (SELECT s.*, history_days, prev, f5, f10, sum(entered_count) OVER w5 AS n5, sum(entered_count) OVER w10 AS n10, min(pred) OVER w5 AS e5, min(pred) OVER w10 AS e10, first_value(active_count) OVER w10 AS base, first_value(s.day) OVER w10 AS base_day, first_value(entered_count) OVER w10 AS base_in
 FROM s JOIN c USING (scope, day) WINDOW w5 AS (PARTITION BY scope, grp, state ORDER BY day RANGE BETWEEN INTERVAL 5 DAYS PRECEDING AND CURRENT ROW), w10 AS (PARTITION BY scope, grp, state ORDER BY day RANGE BETWEEN INTERVAL 10 DAYS PRECEDING AND CURRENT ROW)),
g AS (SELECT *, history_days >= 5 AND f5 <= day - 5 + 2 AND prev >= day - 5 AND (e5 IS NULL OR e5 >= day - 5) AS ok5, history_days >= 10 AND f10 <= day - 10 + 2 AND prev >= day - 10 AND (e10 IS NULL OR e10 >= day - 10) AS ok10 FROM w),
r AS (SELECT *, percent_rank() OVER (PARTITION BY scope, day ORDER BY active_count) AS pr FROM g)
SELECT scope, grp, state, day, active_count, entered_count, history_days, (CASE WHEN ok5 THEN n5 END)::BIGINT AS new_5d, (CASE WHEN ok10 THEN n10 END)::BIGINT AS new_10d,
round(CASE WHEN ok10 AND base_day = f10 AND (n10 = 0 OR base_in = 0) AND base > 0 THEN (active_count - base)::DOUBLE / base END, 8) AS growth_10d, round(pr, 8) AS density_percentile, CASE WHEN pr < 0.5 THEN 'low' WHEN pr < 0.8 THEN 'moderate' ELSE 'elevated' END AS signal_band FROM r""")
def mrt26_recruiting_competition(t: Tables) -> DataFrame:
    calendar = history(t).select(F.pmod("user_id", F.lit(2)).alias("scope"), "day")
    out = H.competition(activity(t), calendar, ["scope"], ["grp", "state"], "user_id", "day", "entered", "previous_date", (5, 10), 10, tolerance=2)
    return out.withColumn("growth_10d", F.round("growth_10d", 8)).withColumn("density_percentile", F.round("density_percentile", 8)).withColumn("history_days", F.col("history_days").cast("long"))


def order_activity(t: Tables) -> DataFrame:
    """Orders by region, nation and priority."""
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.select(F.col("n_regionkey").alias("scope"), F.col("c_nationkey").alias("area"), F.col("o_orderpriority").alias("grp"), "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query("""WITH a AS (SELECT n_regionkey AS scope, c_nationkey AS area, o_orderpriority AS grp, o_orderkey, o_orderdate::DATE AS day FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
m AS (SELECT scope, area, grp, date_trunc('month', day)::DATE AS month, count(DISTINCT o_orderkey) AS n FROM a GROUP BY 1, 2, 3, 4), p AS (SELECT c_nationkey AS area, count(*) AS population FROM customer GROUP BY 1),
h AS (SELECT scope, month, date_diff('day', min(lo) OVER w, max(hi) OVER w) AS days FROM (SELECT scope, date_trunc('month', day)::DATE AS month, min(day) AS lo, max(day) AS hi FROM a GROUP BY 1, 2) WINDOW w AS (PARTITION BY scope ORDER BY month)),
x AS (SELECT m.*, days, avg(n) OVER w AS ta, first_value(n) OVER w AS base, min(m.month) OVER w AS base_month FROM m JOIN h USING (scope, month) WINDOW w AS (PARTITION BY scope, area, grp ORDER BY m.month RANGE BETWEEN INTERVAL 3 MONTHS PRECEDING AND CURRENT ROW))
SELECT scope, area, grp, month, n, round(ta, 6) AS trailing_avg, round(CASE WHEN days >= 90 AND base_month <= month - INTERVAL 3 MONTHS THEN (n - base)::DOUBLE / base END, 8) AS growth, round(n::DOUBLE / population * 100000, 4) AS per_100k FROM x LEFT JOIN p USING (area)""")
def mrt28_condition_trends(t: Tables) -> DataFrame:
    rows = order_activity(t)
    population = t.customer.groupBy(F.col("c_nationkey").alias("area")).agg(F.count("*").alias("population"))
    out = H.monthly_trends(rows, ["scope"], ["area", "grp"], "o_orderkey", "day", population)
    return out.withColumn("trailing_avg", F.round("trailing_avg", 6)).withColumn("growth", F.round("growth", 8))


@query("SELECT l_suppkey, count(DISTINCT l_orderkey) AS n_keys, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS mix FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'O' JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 2")
def mrt29_site_overlap(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders.where("o_orderstatus = 'O'"), F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return access.overlap_hotspots(rows, ["l_suppkey"], "l_orderkey", "p_type")


@query("""WITH n AS (SELECT c_nationkey AS area, o_orderpriority AS node, count(DISTINCT o_orderkey) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), p AS (SELECT c_nationkey AS area, count(*) AS population FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS area, count(*) AS cases, count(*) >= 4 AS confirmed FROM supplier GROUP BY 1)
SELECT area, node, n, round(n::DOUBLE / population * 100000, 4) AS per_100k, CASE WHEN confirmed THEN round(n::DOUBLE / cases * 1000, 4) END AS per_1k_cases, coalesce(confirmed, false) AS denominator_available FROM n LEFT JOIN p USING (area) LEFT JOIN b USING (area)""")
def mrt30_access_rates(t: Tables) -> DataFrame:
    n = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("area"), F.col("o_orderpriority").alias("node")).agg(F.countDistinct("o_orderkey").alias("n"))
    population = t.customer.groupBy(F.col("c_nationkey").alias("area")).agg(F.count("*").alias("population"))
    burden = t.supplier.groupBy(F.col("s_nationkey").alias("area")).agg(F.count("*").alias("cases"))
    return access.area_rates(n, population, burden, "area", F.col("cases") >= 4)


_SITES = "SELECT s_suppkey AS site, CASE WHEN s_suppkey % 11 <> 0 THEN 25 + (s_suppkey * 37 % 200) / 10.0 END AS lat, -120 + (s_suppkey * 53 % 400) / 10.0 AS lon FROM supplier"


@query(f"""WITH s AS ({_SITES}), c AS (SELECT n_nationkey AS area, 25 + (n_nationkey * 37 % 200) / 10.0 AS lat, -120 + (n_nationkey * 53 % 400) / 10.0 AS lon FROM nation),
d AS (SELECT site, area, 2*3958.8*asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(c.lat-s.lat)/2),2) + cos(radians(s.lat))*cos(radians(c.lat))*pow(sin(radians(c.lon-s.lon)/2),2))))) AS miles FROM s, c WHERE s.lat IS NOT NULL),
k AS (SELECT p_type AS node, area, l_orderkey, min(miles) AS miles FROM (SELECT DISTINCT p_type, l_orderkey, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey) JOIN d ON site = l_suppkey WHERE miles <= 100 GROUP BY 1, 2, 3),
a AS (SELECT node, area, min(miles) AS nearest_miles, count(*) FILTER (WHERE miles <= 25) AS w25, count(*) FILTER (WHERE miles <= 50) AS w50, count(*) AS w100 FROM k GROUP BY 1, 2)
SELECT n.node, c.area, round(nearest_miles, 6) AS nearest_miles, coalesce(w25, 0) AS within_25, coalesce(w50, 0) AS within_50, coalesce(w100, 0) AS within_100, CASE WHEN nearest_miles <= 25 THEN 'within_25' WHEN nearest_miles <= 50 THEN 'within_50' WHEN nearest_miles <= 100 THEN 'within_100' ELSE 'none' END AS tier
FROM (SELECT DISTINCT p_type AS node FROM part) n CROSS JOIN c LEFT JOIN a ON a.node = n.node AND a.area = c.area""")
def mrt31_access_by_area(t: Tables) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    points = t.supplier.select(k.alias("site"), F.when(k % 11 != 0, 25 + (k * 37 % 200) / 10.0).alias("a_lat"), (-120 + (k * 53 % 400) / 10.0).alias("a_lon"))
    lines = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_type").alias("node"), F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("site"))
    areas = t.nation.select(n.alias("area"), (25 + (n * 37 % 200) / 10.0).alias("b_lat"), (-120 + (n * 53 % 400) / 10.0).alias("b_lon"))
    out = access.by_area(lines, areas, t.part.select(F.col("p_type").alias("node")).distinct(), (25, 50, 100), points, R.parts(t.lineitem))
    return out.withColumn("nearest_miles", F.round("nearest_miles", 6))


@query("""WITH w AS (SELECT n_regionkey, c_mktsegment, count(*) AS pop, count(*) FILTER (WHERE c_acctbal > 0) AS covered FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)
SELECT 'overall' AS stratum_type, 'all' AS stratum, sum(pop)::BIGINT AS population, round(sum(covered)::DOUBLE / sum(pop), 8) AS covered_share FROM w UNION ALL SELECT 'region', n_regionkey::VARCHAR, sum(pop)::BIGINT, round(sum(covered)::DOUBLE / sum(pop), 8) FROM w GROUP BY 2 UNION ALL SELECT 'segment', c_mktsegment, sum(pop)::BIGINT, round(sum(covered)::DOUBLE / sum(pop), 8) FROM w GROUP BY 2""")
def mrt32_stratum_shares(t: Tables) -> DataFrame:
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_regionkey", "c_mktsegment").agg(F.count("*").alias("pop"), F.count_if(F.col("c_acctbal") > 0).alias("covered"))
    return R.strata(rows, {"overall": F.lit("all"), "region": F.col("n_regionkey"), "segment": F.col("c_mktsegment")}, [F.sum("pop").alias("population"), F.round(safe_divide(F.sum("covered"), F.sum("pop")), 8).alias("covered_share")])


@query("""WITH o AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS r, bool_or(l_returnflag = 'A') AS a, bool_or(l_discount > 0.09) AS amb FROM lineitem GROUP BY 1)
SELECT o_orderpriority, count(*) AS n, round(avg(r::INT), 8) AS reports_r, round(avg(a::INT), 8) AS reports_a, round(avg(amb::INT), 8) AS ambiguous_share FROM o JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1""")
def mrt33_reporting_coverage(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = t.lineitem.join(t.orders.where("o_orderstatus = 'F'"), F.col("o_orderkey") == F.col("l_orderkey"))
    return reports.build_reporting_coverage(rows, ["o_orderpriority"], "l_orderkey", {"reports_r": flag == "R", "reports_a": flag == "A", "ambiguous_share": F.col("l_discount") > 0.09})


@query("""WITH l AS (SELECT p_type, p_brand, l_quantity::BIGINT AS q, l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE year(o_orderdate) >= (SELECT max(year(o_orderdate)) - 4 FROM orders) AND p_size < 6),
c AS (SELECT p_type, p_brand, sum(q)::BIGINT AS n, count(DISTINCT l_orderkey) AS records FROM l GROUP BY 1, 2), f AS (SELECT p_type, p_brand, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY p_type) AS rs FROM part GROUP BY 1, 2), x AS (SELECT c.*, rs, (sum(n) OVER (PARTITION BY p_type))::DOUBLE AS tot FROM c LEFT JOIN f USING (p_type, p_brand)),
y AS (SELECT *, n / tot AS p FROM x)
SELECT p_type, p_brand, n, records, CASE WHEN records >= 3 THEN round(p / rs, 6) END AS ratio, CASE WHEN records >= 3 THEN round(greatest(0, (p + 1.96*1.96/(2*tot) - 1.96*sqrt((p*(1-p) + 1.96*1.96/(4*tot))/tot)) / (1 + 1.96*1.96/tot)) / rs, 6) END AS ratio_low,
CASE WHEN records >= 3 THEN round(least(1, (p + 1.96*1.96/(2*tot) + 1.96*sqrt((p*(1-p) + 1.96*1.96/(4*tot))/tot)) / (1 + 1.96*1.96/tot)) / rs, 6) END AS ratio_high, records < 3 AS suppressed, records >= 3 AND records < 5 AS low_n FROM y""")
def mrt34_participation_ratio(t: Tables) -> DataFrame:
    newest = t.orders.agg((F.max(F.year("o_orderdate")) - 4).alias("since"))
    orders = t.orders.crossJoin(F.broadcast(newest)).where(F.year("o_orderdate") >= F.col("since"))  # one row
    rows = t.lineitem.join(t.part.where("p_size < 6"), F.col("p_partkey") == F.col("l_partkey")).join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    counts = rows.groupBy("p_type", "p_brand").agg(F.sum(F.col("l_quantity").cast("long")).alias("n"), F.countDistinct("l_orderkey").alias("records"))
    parts = t.part.groupBy("p_type", "p_brand").agg(F.count("*").alias("k"))
    reference = parts.join(parts.groupBy("p_type").agg(F.sum("k").alias("all_k")), "p_type").select("p_type", "p_brand", safe_divide(F.col("k"), F.col("all_k")).alias("reference_share"))
    return access.participation_ratio(counts, reference, ["p_type"], "p_brand")


@query("SELECT o_orderpriority, year(o_orderdate) AS yr, count(DISTINCT o_orderkey) AS n, string_agg(DISTINCT o_orderkey::VARCHAR, ', ' ORDER BY o_orderkey::VARCHAR) AS ids FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') GROUP BY 1, 2")
def mrt35_stopped_summary(t: Tables) -> DataFrame:
    rows = t.orders.where("o_orderstatus = 'P'").withColumn("yr", F.year("o_orderdate").cast("long")).withColumn("o_orderkey", F.col("o_orderkey").cast("string"))
    return access.stopped_summary(rows, ["o_orderpriority", "yr"], "o_orderkey")


@query("""WITH e AS (SELECT c_nationkey, count(*) FILTER (WHERE ev) AS evaluable, count(*) FILTER (WHERE ev AND o_orderstatus = 'F') AS posted FROM (SELECT *, o_orderstatus IN ('F','O') AND o_orderdate < TIMESTAMP '1998-08-02' - INTERVAL 365 DAYS AND o_totalprice > 400000 AS ev FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY 1),
s AS (SELECT *, posted::DOUBLE / nullif(evaluable, 0) AS share FROM e)
SELECT c_nationkey, evaluable, posted, round(share, 8) AS share, round(CASE WHEN evaluable > 0 THEN greatest(0, (share + 1.96*1.96/(2*evaluable) - 1.96*sqrt((share*(1-share) + 1.96*1.96/(4*evaluable))/evaluable)) / (1 + 1.96*1.96/evaluable)) END, 8) AS low, round(CASE WHEN evaluable > 0 THEN least(1, (share + 1.96*1.96/(2*evaluable) + 1.96*sqrt((share*(1-share) + 1.96*1.96/(4*evaluable))/evaluable)) / (1 + 1.96*1.96/evaluable)) END, 8) AS high,
CASE WHEN evaluable >= 5 THEN rank() OVER (PARTITION BY evaluable >= 5 ORDER BY share DESC NULLS LAST) END AS rank FROM s""")
def mrt36_posting_transparency(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    overdue = F.col("o_orderstatus").isin("F", "O") & (F.col("o_orderdate") < F.lit("1997-08-02").cast("timestamp_ntz")) & (F.col("o_totalprice") > 400000)
    out = access.posting_transparency(rows, ["c_nationkey"], "o_orderkey", overdue, F.col("o_orderstatus") == "F")
    return out.select("c_nationkey", "evaluable", "posted", *(F.round(c, 8).alias(c) for c in ("share", "low", "high")), F.col("rank").cast("long").alias("rank"))


@query("""SELECT ts::DATE AS day, count(*) AS n, round(avg((value < 1)::INT), 8) AS missing_share, round(avg((event_type = 'error')::INT), 8) AS error_share, count(DISTINCT user_id) AS users, count(*) = count(DISTINCT event_id) AS keys_unique FROM events GROUP BY 1""")
def mrt37_data_reliability(t: Tables) -> DataFrame:
    shares = {"missing_share": F.col("value") < 1, "error_share": F.col("event_type") == "error"}
    return reports.build_reliability(t.events, F.col("ts").cast("date"), "day", shares, "user_id", "users", "event_id")
