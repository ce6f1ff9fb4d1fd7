"""Filters, joins, aggregates, sorts and set operations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import haversine_miles, safe_divide
from ..operators import relational as R
from ..registry import Tables, query


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O','P') AND (nullif(o_orderpriority,'3-MEDIUM') IS NULL OR trim(o_orderpriority) = '1-URGENT')")
def fil1_snapshot_gate(t: Tables) -> DataFrame:
    blank = F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority"))
    return t.orders.where(F.col("o_orderstatus").isin("O", "P") & (blank.isNull() | (F.trim("o_orderpriority") == "1-URGENT"))).select("o_orderkey")


@query("SELECT e.event_id FROM events e LEFT JOIN (SELECT user_id, min(ts) AS started FROM events WHERE event_type = 'signup' GROUP BY 1) s USING (user_id) WHERE s.started IS NULL OR e.ts >= s.started")
def fil3_trust_gate(t: Tables) -> DataFrame:
    started = t.events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("started"))
    return t.events.join(started, "user_id", "left").where("started IS NULL OR ts >= started").select("event_id")


@query("SELECT o_orderkey, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus IN ('O','F') AND (o_orderpriority || '/X' = '1-URGENT' OR list_contains(string_split(o_orderpriority || '/X', '/'), '1-URGENT')) AND (nullif(c_acctbal, 0) IS NULL OR c_acctbal <= 5000) AND o_orderdate >= TIMESTAMP '1995-01-01'")
def fil5_optional_parameters(t: Tables) -> DataFrame:
    statuses, phase, balance, since, ignored = ["O", "F"], "1-URGENT", 5000, "1995-01-01", None
    joined = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    out = R.optional_filter(
        joined,
        status=(statuses, F.col("o_orderstatus").isin(statuses)),
        phase=(phase, R.member_of(F.concat("o_orderpriority", F.lit("/X")), F.lit(phase))),
        balance=(balance, F.col("c_acctbal").isNull() | (F.col("c_acctbal") <= balance)),
        since=(since, F.col("o_orderdate") >= F.lit(since).cast("timestamp_ntz")),
        segment=(ignored, F.col("c_mktsegment") == "never"),
    )
    return out.select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') OR o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 7)")
def fil6_any_exists(t: Tables) -> DataFrame:
    returned = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    sized = t.lineitem.join(t.part.where("p_size = 7"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.any_key_set(t.orders, "o_orderkey", returned, sized).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license, version') OR contains(lower(text), '100%')")
def fil7_contains_literal(t: Tables) -> DataFrame:
    return t.documents.where(R.any_of(R.contains_text(F.col("text"), "License, Version"), R.contains_text(F.col("text"), "100%"))).select("doc_id")


@query("SELECT a.o_orderstatus AS status, count(*) AS n FROM (SELECT nullif(o_orderstatus,'P') AS o_orderstatus, o_custkey FROM orders) a JOIN (SELECT DISTINCT nullif(o_orderstatus,'P') AS s FROM orders) b ON a.o_orderstatus IS NOT DISTINCT FROM b.s GROUP BY 1")
def fil8_join15_null_safe(t: Tables) -> DataFrame:
    a = t.orders.select(F.nullif("o_orderstatus", F.lit("P")).alias("status"), "o_custkey")
    return R.null_safe_join(a, a.select("status").distinct(), ["status"]).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def fil9_not_exists(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') OR c_custkey NOT IN (SELECT o_custkey FROM orders)")
def fil10_scope_or_unmapped(t: Tables) -> DataFrame:
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return R.in_or_unmapped(t.customer, "c_custkey", orders.where("o_orderpriority = '1-URGENT'"), orders).select("c_custkey")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts::DATE = (SELECT max(ts::DATE) FROM events) GROUP BY 1")
def fil11_latest_date(t: Tables) -> DataFrame:
    return R.at_latest(t.events.withColumn("day", F.col("ts").cast("date")), "day").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT p_type, year(o_orderdate) AS yr, count(*) AS lines, round(sum(l_extendedprice), 2) AS price FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def join1_inner(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return joined.groupBy("p_type", F.year("o_orderdate").cast("long").alias("yr")).agg(F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT c_custkey, count(o_orderkey) AS n, max(o_orderdate)::DATE AS last_day FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join2_left(t: Tables) -> DataFrame:
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").cast("date").alias("last_day"))
    return t.customer.join(per, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "last_day")


@query("SELECT p_type, round(sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lineitem), 8) AS share FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def join3_share_of_total(t: Tables) -> DataFrame:
    per = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_type").agg(F.sum("l_extendedprice").alias("price"))
    total = t.lineitem.agg(F.sum("l_extendedprice").alias("total"))  # one row
    return per.crossJoin(F.broadcast(total)).select("p_type", F.round(safe_divide(F.col("price"), F.col("total")), 8).alias("share"))


@query("SELECT p.p_type, n.n_nationkey, count(l.l_orderkey) AS lines FROM (SELECT DISTINCT p_type FROM part) p CROSS JOIN nation n LEFT JOIN (SELECT l_orderkey, p_type, s_nationkey FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey) l ON l.p_type = p.p_type AND l.s_nationkey = n.n_nationkey GROUP BY 1, 2")
def join4_dimension_grid(t: Tables) -> DataFrame:
    per = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    per = per.groupBy("p_type", F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("lines"))
    grid = t.part.select("p_type").distinct().crossJoin(F.broadcast(t.nation.select("n_nationkey")))  # types x 25 nations
    return grid.join(per, ["p_type", "n_nationkey"], "left").select("p_type", "n_nationkey", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("""WITH r AS (SELECT p_partkey AS k, p_type || '|' || p_size || '|' || p_brand AS tok FROM part), u AS (SELECT tok FROM r GROUP BY 1 HAVING count(*) < 40),
p AS (SELECT DISTINCT x.k AS a, y.k AS b FROM r x JOIN r y USING (tok) JOIN u USING (tok) WHERE x.k < y.k) SELECT a, b FROM p UNION ALL SELECT b, a FROM p""")
def join5_set2_pairs_by_token(t: Tables) -> DataFrame:
    parts = t.part.withColumn("tok", F.concat_ws("|", "p_type", "p_size", "p_brand"))
    return R.mirrored(R.pairs_by_token(parts, "p_partkey", "tok", 40))


_POINTS = "SELECT {k} AS k, 25 + ({k} * 37 % 200) / 10.0 AS lat, -120 + ({k} * 53 % 400) / 10.0 AS lon FROM {t}"


@query(f"""WITH a AS ({_POINTS.format(k="s_suppkey", t="supplier")}), b AS ({_POINTS.format(k="n_nationkey", t="nation")}),
d AS (SELECT a.k AS site, b.k AS county, 2*3958.8*asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(b.lat-a.lat)/2),2) + cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2))))) AS miles FROM a, b)
SELECT site, county, round(miles, 6) AS miles FROM d WHERE miles <= 100""")
def join7_within_miles(t: Tables) -> DataFrame:
    point = lambda k, p: (F.col(k).alias(p), (25 + (F.col(k) * 37 % 200) / 10.0).alias(f"{p[0]}_lat"), (-120 + (F.col(k) * 53 % 400) / 10.0).alias(f"{p[0]}_lon"))
    a, b = t.supplier.select(*point("s_suppkey", "a_key")), t.nation.select(*point("n_nationkey", "b_key"))
    near = R.within_miles(a, b, 100, haversine_miles(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
    return near.select(F.col("a_key").alias("site"), F.col("b_key").alias("county"), F.round("miles", 6).alias("miles"))


@query("""WITH m(label, dim, kind) AS (VALUES ('PROMO','a','one'), ('PROMO',NULL,'both'), ('STANDARD',NULL,'one'), ('ECONOMY','b','one'))
SELECT p_partkey, m.kind FROM part LEFT JOIN m ON split_part(p_type, ' ', 1) = m.label AND (m.dim = CASE WHEN p_size > 25 THEN 'a' ELSE 'b' END OR (m.dim IS NULL AND m.kind <> 'both'))""")
def join8_conditional_left(t: Tables) -> DataFrame:
    labels = t.spark.createDataFrame([("PROMO", "a", "one"), ("PROMO", None, "both"), ("STANDARD", None, "one"), ("ECONOMY", "b", "one")], "label string, dim string, kind string")
    side = F.when(F.col("p_size") > 25, "a").otherwise("b")
    on = (F.split_part("p_type", F.lit(" "), F.lit(1)) == F.col("label")) & ((F.col("dim") == side) | (F.col("dim").isNull() & (F.col("kind") != "both")))
    return t.part.join(F.broadcast(labels), on, "left").select("p_partkey", "kind")  # four hand-written rows


@query("""WITH c AS (SELECT s_suppkey, 'N' || (s_suppkey % 25) AS city, 'N' || (s_suppkey % 7) AS short FROM supplier), g AS (SELECT n_nationkey, 'N' || n_nationkey AS name FROM nation)
SELECT DISTINCT s_suppkey, n_nationkey FROM c JOIN g ON city = name OR short = name""")
def join9_either_key(t: Tables) -> DataFrame:
    c = t.supplier.select("s_suppkey", F.concat(F.lit("N"), F.col("s_suppkey") % 25).alias("city"), F.concat(F.lit("N"), F.col("s_suppkey") % 7).alias("short"))
    g = t.nation.select("n_nationkey", F.concat(F.lit("N"), "n_nationkey").alias("name"))
    return R.either_key_join(c, g, ["city", "short"], "name", "s_suppkey").select("s_suppkey", "n_nationkey")


@query("""WITH r(kind, term, ord, label) AS (VALUES ('exact','part 7',1,'seven'), ('substring','part 1',2,'ones'), ('substring','9',3,'nines'), ('substring','art 11',1,'elevens')),
h AS (SELECT p_partkey, label, CASE kind WHEN 'exact' THEN 0 ELSE 1 END AS tier, ord FROM (SELECT p_partkey, 'part ' || p_partkey AS nm FROM part) JOIN r ON (kind = 'exact' AND nm = term) OR (kind = 'substring' AND contains(nm, term)))
SELECT p.p_partkey, h.label, h.tier FROM part p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY tier, ord, label) AS rn FROM h) h ON h.p_partkey = p.p_partkey AND rn = 1""")
def join10_tiered_rules(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([("exact", "part 7", 1, "seven"), ("substring", "part 1", 2, "ones"), ("substring", "9", 3, "nines"), ("substring", "art 11", 1, "elevens")], "kind string, term string, ord int, label string")
    named = t.part.select("p_partkey", F.concat(F.lit("part "), "p_partkey").alias("nm"))
    return R.tiered_rules(named, "nm", rules, "p_partkey").select("p_partkey", "label", "tier")


@query("""WITH a AS (SELECT DISTINCT user_id AS k, ts::DATE AS d1 FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id AS k, ts::DATE AS d2 FROM events WHERE event_type = 'signup'),
j AS (SELECT a.k, d1, d2, abs(date_diff('day', d1, d2)) AS gap FROM a JOIN b USING (k) WHERE abs(date_diff('day', d1, d2)) <= 7),
m AS (SELECT *, row_number() OVER (PARTITION BY k, d1 ORDER BY gap, d2) AS rn FROM j)
SELECT a.k, a.d1, m.d2, m.gap FROM a LEFT JOIN m ON m.k = a.k AND m.d1 = a.d1 AND rn = 1""")
def join12_nearest_within(t: Tables) -> DataFrame:
    of = lambda kind, d: t.events.where(F.col("event_type") == kind).select(F.col("user_id").alias("k"), F.col("ts").cast("date").alias(d)).distinct()
    return R.nearest_within(of("purchase", "d1"), of("signup", "d2"), "k", "d1", "d2", 7).withColumn("gap", F.col("gap").cast("long"))


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS orders, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.k = b.k")
def join14_full_outer(t: Tables) -> DataFrame:
    a = t.orders.join(t.customer.where("c_nationkey < 15"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("orders"))
    b = t.supplier.where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full")


@query("""SELECT o_orderkey, (SELECT string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned FROM orders""")
def join16_agg9_nested_lists(t: Tables) -> DataFrame:
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    per = t.lineitem.groupBy("l_orderkey").agg(lines.alias("s"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    shown = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_returnflag"])), ",")
    return t.orders.join(per, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", shown.alias("lines"), F.coalesce("returned", F.lit(0)).alias("returned"))


@query("""SELECT c_nationkey, count(DISTINCT o_custkey) AS every, count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'O') AS open, count(DISTINCT o_custkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def agg1_2_filtered_distinct(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return R.distinct_where(joined, ["c_nationkey"], "o_custkey", {"every": F.lit(True), "open": F.col("o_orderstatus") == "O", "urgent": F.col("o_orderpriority") == "1-URGENT"})


@query("SELECT p_size, count(DISTINCT nullif(p_brand,'Brand#1') || '|' || coalesce(p_type,'')) AS n FROM part GROUP BY 1")
def agg3_composite_distinct(t: Tables) -> DataFrame:
    return t.part.groupBy("p_size").agg(F.countDistinct(F.concat(F.nullif("p_brand", F.lit("Brand#1")), F.lit("|"), F.coalesce("p_type", F.lit("")))).alias("n"))


@query("""SELECT event_type, count(*) AS n, round((count(*) FILTER (WHERE value > 50))::DOUBLE / count(*), 8) AS high_share, round(sum(value) FILTER (WHERE user_id % 2 = 0), 4) AS even_sum, min(ts) FILTER (WHERE value > 50) AS first_high, bool_or(value > 99) AS any_top, bool_and(value >= 0) AS all_positive FROM events GROUP BY 1""")
def agg4_5_6_conditional(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(safe_divide(F.count_if(v > 50), F.count("*")), 8).alias("high_share"), F.round(F.sum(F.when(F.col("user_id") % 2 == 0, v)), 4).alias("even_sum"), F.min(F.when(v > 50, F.col("ts"))).alias("first_high"), F.bool_or(v > 99).alias("any_top"), F.every(v >= 0).alias("all_positive"))


@query("SELECT n_name, string_agg(DISTINCT s_suppkey % 5 || '', ', ' ORDER BY s_suppkey % 5 || '') AS mix, min(s_name) AS a_name FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def agg7_8_12_ordered_strings(t: Tables) -> DataFrame:
    kind = (F.col("s_suppkey") % 5).cast("string")
    per = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.sort_array(F.collect_set(kind)).alias("kinds"), F.min("s_name").alias("a_name"))
    return per.select("n_name", F.when(F.size("kinds") > 0, F.array_join("kinds", ", ")).alias("mix"), "a_name")


@query("""SELECT c_nationkey, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def agg10_pivot(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    wide = joined.groupBy("c_nationkey").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).count()
    return wide.select("c_nationkey", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("5-LOW", F.lit(0)).alias("low"))


@query("""WITH w AS (SELECT s_nationkey, p_type, s_suppkey, count(*) AS w FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
s AS (SELECT *, w::DOUBLE / sum(w) OVER (PARTITION BY s_nationkey, p_type) AS share FROM w)
SELECT s_nationkey, p_type, count(s_suppkey) AS owners, round(CASE WHEN count(s_suppkey) >= 3 THEN sum(share*share) END, 8) AS hhi, round(max(share), 8) AS top_share FROM s GROUP BY 1, 2""")
def agg11_concentration(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    out = R.concentration(joined, ["s_nationkey", "p_type"], "s_suppkey", F.count("*"))
    return out.select("s_nationkey", "p_type", "owners", F.round("hhi", 8).alias("hhi"), F.round("top_share", 8).alias("top_share"))


@query("SELECT l_orderkey, md5(string_agg(l_linenumber || '|' || l_partkey || '|' || l_returnflag, '##' ORDER BY l_linenumber, l_linenumber || '|' || l_partkey || '|' || l_returnflag)) AS set_hash FROM lineitem GROUP BY 1")
def agg14_set_hash(t: Tables) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", F.concat_ws("|", "l_linenumber", "l_partkey", "l_returnflag").alias("s"))))
    return t.lineitem.groupBy("l_orderkey").agg(F.md5(F.array_join(F.transform(rows, lambda r: r["s"]), "##")).alias("set_hash"))


@query("SELECT p_type, p_brand, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY p_type), 8) AS share FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def agg15_share_of_dimension(t: Tables) -> DataFrame:
    per = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_type", "p_brand").agg(F.sum("l_quantity").alias("q"))
    totals = per.groupBy("p_type").agg(F.sum("q").alias("all_q"))
    return per.join(totals, "p_type").select("p_type", "p_brand", F.round(safe_divide(F.col("q"), F.col("all_q")), 8).alias("share"))


@query("""SELECT 'overall' AS stratum_type, 'all' AS stratum, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders UNION ALL SELECT 'status', o_orderstatus, count(*), round(sum(o_totalprice), 2) FROM orders GROUP BY 2
UNION ALL SELECT 'priority', o_orderpriority, count(*), round(sum(o_totalprice), 2) FROM orders GROUP BY 2""")
def agg16_strata(t: Tables) -> DataFrame:
    return R.strata(t.orders, {"overall": F.lit("all"), "status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}, [F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price")])


@query("""WITH v AS (SELECT l_returnflag, coalesce(CASE WHEN l_linenumber < 6 THEN l_extendedprice END, 'inf'::DOUBLE) AS v, l_quantity AS w FROM lineitem),
c AS (SELECT l_returnflag, v, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS upto, sum(w) OVER (PARTITION BY l_returnflag) AS every FROM v)
SELECT l_returnflag, CASE WHEN isfinite(min(v)) THEN min(v) END AS median FROM c WHERE 2 * upto >= every GROUP BY 1""")
def agg17_weighted_median(t: Tables) -> DataFrame:
    priced = t.lineitem.withColumn("v", F.when(F.col("l_linenumber") < 6, F.col("l_extendedprice")))
    return R.weighted_median(priced, ["l_returnflag"], "v", "l_quantity")


@query("""SELECT unnest(['event_id','user_id','kind']) AS column_name, count(*) AS n_rows, count(DISTINCT user_id) AS n_keys, unnest([count(event_id), count(user_id), count(nullif(event_type, 'error'))])::DOUBLE / count(*) AS filled_share FROM events""")
def agg18_profile(t: Tables) -> DataFrame:
    return R.profile(t.events.select("event_id", "user_id", F.nullif("event_type", F.lit("error")).alias("kind")), "user_id")


@query("SELECT o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL")
def agg13_19_value_counts(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).count().withColumnRenamed("count", "n")


@query("""WITH l AS (SELECT c_nationkey, string_agg(c_custkey || '', ', ' ORDER BY c_custkey) AS ids FROM customer GROUP BY 1, c_mktsegment)
SELECT c_nationkey, string_agg(DISTINCT id, ', ' ORDER BY id) AS ids, count(DISTINCT id) AS n FROM (SELECT c_nationkey, unnest(string_split(ids, ', ')) AS id FROM l) GROUP BY 1""")
def agg20_id_list_rollup(t: Tables) -> DataFrame:
    lists = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.array_join(F.sort_array(F.collect_list("c_custkey")), ", ").alias("ids"))
    ids = lists.select("c_nationkey", F.explode(F.split("ids", ", ")).alias("id"))
    return ids.groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_set("id")), ", ").alias("ids"), F.countDistinct("id").alias("n"))


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC NULLS LAST, s_suppkey LIMIT 20")
def srt1_2_top_suppliers(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", "s_acctbal").orderBy(F.col("s_acctbal").desc_nulls_last(), "s_suppkey").limit(20)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey > 100) ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 26")
def srt3_keyset_page(t: Tables) -> DataFrame:
    from ..operators.paging import keyset_page

    return keyset_page(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", after=(200000.0, 100), size=25)


@query("WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS rn FROM d) SELECT user_id, day FROM r WHERE rn > 5")
def srt5_retention(t: Tables) -> DataFrame:
    from ..operators.windows import beyond_newest

    return beyond_newest(t.events.select("user_id", F.col("ts").cast("date").alias("day")).distinct(), ["user_id"], "day", 5)


@query("SELECT kind, count(*) AS n FROM (SELECT 'order' AS kind, o_custkey AS k FROM orders UNION ALL SELECT 'customer', c_custkey FROM customer) GROUP BY 1")
def set1_union(t: Tables) -> DataFrame:
    both = t.orders.select(F.lit("order").alias("kind"), F.col("o_custkey").alias("k")).unionByName(t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("k")))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def set3_distinct(t: Tables) -> DataFrame:
    return t.part.select("p_brand", "p_type").distinct()


@query("SELECT side, k FROM ((SELECT 'only_a' AS side, o_custkey AS k FROM orders WHERE o_orderstatus = 'O' EXCEPT ALL SELECT 'only_a', o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL (SELECT 'only_b', o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT 'only_b', o_custkey FROM orders WHERE o_orderstatus = 'O'))")
def set4_5_except_both_ways(t: Tables) -> DataFrame:
    a, b = (t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "OF")
    side = lambda df, name: df.select(F.lit(name).alias("side"), "k")
    return side(a.exceptAll(b), "only_a").unionByName(side(b.exceptAll(a), "only_b"))
