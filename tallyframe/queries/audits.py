"""Search, audits, roll-ups and checks on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsons
from ..functions.numbers import haversine_miles
from ..operators import audit, quality, terms
from ..operators import relational as R
from ..operators.paging import keyset_page
from ..plans import dimensions, history as H, reports
from ..registry import Tables, query
from .products import activity, order_activity
from .windowed import DAILY_SQL, HISTORY_SQL, daily, history


@query("""WITH s AS (SELECT l_orderkey, min(2*3958.8*asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians((25 + s_nationkey) - 30.0)/2),2) + cos(radians(30.0))*cos(radians(25.0 + s_nationkey))*pow(sin(radians((-120.0 + 2*s_nationkey) - (-100.0))/2),2)))))) AS miles FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1),
m AS (SELECT o_orderkey, o_orderdate, miles FROM orders JOIN s ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT','2-HIGH') AND miles <= 400)
SELECT o_orderkey, round(miles, 6) AS miles, (SELECT count(*) FROM m) AS total FROM m WHERE o_orderdate < TIMESTAMP '1998-01-01' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 21""")
def qry1_search_page(t: Tables) -> DataFrame:
    k = F.col("s_nationkey")
    miles = haversine_miles(F.lit(30.0), F.lit(-100.0), 25.0 + k, -120.0 + 2 * k)
    sites = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).groupBy("l_orderkey").agg(F.min(miles).alias("miles"))
    wanted = F.col("o_orderstatus").isin("O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    found = t.orders.where(wanted).join(sites, F.col("l_orderkey") == F.col("o_orderkey")).where("miles <= 400")
    page = keyset_page(found.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")), "o_orderdate", "o_orderkey", size=20)
    return page.crossJoin(F.broadcast(found.agg(F.count("*").alias("total")))).select("o_orderkey", F.round("miles", 6).alias("miles"), "total")  # the total is one row


@query("""WITH x AS (SELECT * FROM part WHERE p_partkey = 1), c AS (SELECT p.p_partkey, (p.p_type = x.p_type)::INT * 2 + (p.p_brand = x.p_brand)::INT AS hit, p.p_size, x.p_size AS xs FROM part p, x WHERE p.p_partkey <> x.p_partkey AND (p.p_type = x.p_type OR p.p_brand = x.p_brand)),
l AS (SELECT * FROM c ORDER BY hit DESC, p_partkey LIMIT 250) SELECT p_partkey, round(CASE WHEN hit >= 2 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN hit IN (1, 3) THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN abs(p_size - xs) < 10 THEN 0.2::DOUBLE ELSE 0 END, 4) AS score FROM l ORDER BY score DESC, p_partkey LIMIT 10""")
def qry3_related_on_demand(t: Tables) -> DataFrame:
    one = t.part.where("p_partkey = 1").select(F.col("p_type").alias("x_type"), F.col("p_brand").alias("x_brand"), F.col("p_size").alias("x_size"))  # one row
    same_type, same_brand = F.col("p_type") == F.col("x_type"), F.col("p_brand") == F.col("x_brand")
    factors = {"type": (same_type, 0.5), "brand": (same_brand, 0.3), "size": (F.abs(F.col("p_size") - F.col("x_size")) < 10, 0.2)}
    order = [(same_type.cast("int") * 2 + same_brand.cast("int")).desc()]
    return reports.build_related(t.part.where("p_partkey <> 1"), "p_partkey", one, factors, ["type", "brand"], order, 250, 10)


@query("""WITH n AS (SELECT p_partkey AS concept, p_name AS name, true AS main FROM part UNION ALL SELECT p_partkey, p_type || ' ' || p_brand, false FROM part),
s AS (SELECT *, CASE WHEN lower(name) = 'small' THEN 100 WHEN starts_with(lower(name), 'small') THEN 80 WHEN contains(' ' || lower(name), ' small') THEN 65 WHEN contains(lower(name), 'small') THEN 50 ELSE 0 END - CASE WHEN main THEN 0 ELSE 10 END AS score FROM n WHERE contains(lower(name), 'small'))
SELECT concept, score::INTEGER AS score, term FROM (SELECT concept, max(score) AS score, min(name) FILTER (WHERE main) AS term FROM s WHERE score > 0 GROUP BY 1) ORDER BY score DESC, length(term), term, concept LIMIT 30""")
def qry6_term_search(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_partkey").alias("concept"), F.explode(F.array(F.struct(F.col("p_name").alias("name"), F.lit(True).alias("main")), F.struct(F.concat_ws(" ", "p_type", "p_brand").alias("name"), F.lit(False).alias("main")))).alias("n")).select("concept", "n.name", "n.main")
    return terms.search_terms(names, "Small", 30)


@query("SELECT p_type AS node, count(DISTINCT l_orderkey) AS total, count(DISTINCT l_orderkey) FILTER (WHERE o_orderstatus = 'O') AS active FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def qry7_node_counts(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    rows = R.dealt_join(lines, t.orders, "l_orderkey", "o_orderkey", R.parts(t.lineitem))
    return reports.build_node_counts(rows.withColumnRenamed("p_type", "node"), "node", "l_orderkey", F.col("o_orderstatus") == "O")


@query("""WITH c AS (SELECT 'R' || r_regionkey AS concept, 'A' || r_regionkey AS code FROM region UNION ALL SELECT 'N' || n_nationkey, 'A' || n_regionkey || '.' || n_nationkey FROM nation UNION ALL SELECT 'S' || s_suppkey, 'A' || n_regionkey || '.' || CASE WHEN s_suppkey % 4 = 0 THEN 'none' ELSE s_nationkey || '' END || '.' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey),
p AS (SELECT c.concept, c.code, b.concept AS broader, row_number() OVER (PARTITION BY c.concept, c.code ORDER BY length(b.code) DESC, b.concept) AS rn FROM c JOIN c b ON starts_with(c.code, b.code || '.'))
SELECT c.concept, c.code, p.broader FROM c LEFT JOIN p ON p.concept = c.concept AND p.code = c.code AND rn = 1""")
def qry8_tree_hierarchy(t: Tables) -> DataFrame:
    r = t.region.select(F.concat(F.lit("R"), "r_regionkey").alias("concept"), F.concat(F.lit("A"), "r_regionkey").alias("code"))
    n = t.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("concept"), F.concat(F.lit("A"), "n_regionkey", F.lit("."), "n_nationkey").alias("code"))
    middle = F.when(F.col("s_suppkey") % 4 == 0, "none").otherwise(F.col("s_nationkey").cast("string"))
    s = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.concat(F.lit("S"), "s_suppkey").alias("concept"), F.concat(F.lit("A"), "n_regionkey", F.lit("."), middle, F.lit("."), "s_suppkey").alias("code"))
    return terms.broader(r.unionByName(n).unionByName(s))


@query(f"WITH {HISTORY_SQL} SELECT DISTINCT user_id, day, first_seen FROM history WHERE event_type = 'purchase' AND user_id % 3 = 1 AND day = (SELECT max(day) FROM history)")
def qry9_drill_through(t: Tables) -> DataFrame:
    return reports.build_drill_through(history(t), "day", F.expr("event_type = 'purchase' AND user_id % 3 = 1"), ["user_id", "day", "first_seen"])


@query("""SELECT s_suppkey, count(DISTINCT l_orderkey) AS orders, count(DISTINCT p_type) AS types, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS mix FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1 ORDER BY orders DESC, s_suppkey LIMIT 25""")
def qry10_sponsor_landscape(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).withColumnRenamed("l_suppkey", "s_suppkey")
    return reports.build_owner_landscape(rows, "s_suppkey", "l_orderkey", "p_type", ("orders", "types", "mix"), 25)


@query("SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open, (SELECT count(DISTINCT o_custkey) FROM orders) AS buyers, (SELECT count(*) FROM supplier) AS suppliers, (SELECT max(ts)::DATE FROM events) AS latest_day")
def qry12_overview(t: Tables) -> DataFrame:
    orders = [F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.countDistinct("o_custkey").alias("buyers")]
    return reports.build_overview((t.orders, orders), (t.supplier, [F.count("*").alias("suppliers")]), (t.events, [F.max("ts").cast("date").alias("latest_day")]))


@query("""WITH d AS (SELECT o_orderkey, c_nationkey % 3 AS region, CASE WHEN o_orderstatus = 'P' THEN 'status' WHEN c_acctbal < 0 THEN 'negative balance' WHEN o_totalprice > 400000 THEN 'too large' END AS reason, CASE WHEN c_nationkey < 10 THEN 'inside' WHEN c_nationkey > 15 THEN 'outside' ELSE 'undetermined' END AS placed FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT region, placed, CASE WHEN reason IS NULL THEN 'included' ELSE 'excluded' END AS decision, reason, count(DISTINCT o_orderkey) AS n FROM d GROUP BY ALL""")
def qry15_audit_decisions(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).withColumn("region", F.col("c_nationkey") % 3)
    rows = rows.withColumn("placed", audit.contribution(F.col("c_nationkey") < 10, F.col("c_nationkey") > 15))
    decided = audit.decisions(rows, [("status", F.col("o_orderstatus") == "P"), ("negative balance", F.col("c_acctbal") < 0), ("too large", F.col("o_totalprice") > 400000)])
    return audit.summary(decided, ["region", "placed"], "o_orderkey")


@query("""WITH a AS (SELECT n_regionkey, c_mktsegment, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 8000) AS far FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)
SELECT n_regionkey, max(round(far::DOUBLE / n, 8)) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, max(round(far::DOUBLE / n, 8)) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery, bool_or(far::DOUBLE / n > 0.25) AS any_gap FROM a GROUP BY 1""")
def qry18_gap_matrix(t: Tables) -> DataFrame:
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return reports.build_gap_matrix(rows, "n_regionkey", "c_mktsegment", {"building": "BUILDING", "machinery": "MACHINERY"}, F.col("c_acctbal") > 8000, 0.25)


@query(f"""WITH {HISTORY_SQL}, d AS (SELECT day, count(*) FILTER (WHERE event_type = 'purchase') AS density FROM history GROUP BY 1), hh AS (SELECT user_id, day, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY day) AS next_type FROM history),
n AS (SELECT *, ntile(3) OVER (ORDER BY density, day) AS tercile FROM d)
SELECT tercile, count(*) AS n, round(avg((next_type = 'error')::INT), 8) AS terminal_rate, round(avg((next_type = 'purchase')::INT), 8) AS still_rate, count(*) < 30 AS inconclusive FROM hh JOIN n USING (day) WHERE event_type = 'purchase' AND next_type IS NOT NULL GROUP BY 1""")
def qry20_tercile_outcomes(t: Tables) -> DataFrame:
    active = F.col("event_type") == "purchase"
    return reports.build_tercile_outcomes(history(t), "user_id", "day", "event_type", active, {"terminal_rate": "error", "still_rate": "purchase"}, 30)


@query("""WITH p AS (SELECT s_nationkey, o_orderpriority, count(DISTINCT o_orderkey) AS n, count(DISTINCT o_orderkey) FILTER (WHERE l_returnflag = 'R') AS overlapped, avg((l_discount <= 0.08)::INT) AS quality, avg((l_quantity > 5)::INT) AS usable FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)
SELECT s_nationkey, o_orderpriority, n, round(overlapped::DOUBLE / n, 8) AS overlap_share, round(0.5 * quality + 0.5 * usable, 8) AS completeness FROM p""")
def mrt27_priority_queue(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    rows = R.dealt_join(lines, t.orders, "l_orderkey", "o_orderkey", R.parts(t.lineitem))
    return reports.build_priority_queue(rows, ["s_nationkey", "o_orderpriority"], "o_orderkey", F.col("l_returnflag") == "R", F.col("l_discount") <= 0.08, F.col("l_quantity") > 5)


@query("""WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate,'%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate,'%Y-%m') WHEN 2 THEN strftime(o_orderdate,'%Y') END AS s, o_orderstatus FROM orders)
SELECT CASE WHEN s IS NULL THEN 'missing' WHEN length(s) = 10 THEN 'day' WHEN length(s) = 7 THEN 'month' ELSE 'year' END AS precision, CASE WHEN o_orderstatus = 'P' THEN 'status' WHEN s IS NULL THEN 'no date' END AS exclusion_reason, count(*) AS n, max(date_diff('month', coalesce(try_strptime(s,'%Y-%m-%d'), try_strptime(s,'%Y-%m'), try_strptime(s,'%Y'))::DATE, DATE '1999-01-01')) AS oldest_months FROM d GROUP BY 1, 2""")
def mrt38_date_precision_audit(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 4
    s = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).when(k == 2, F.date_format("o_orderdate", "yyyy"))
    reason = F.when(F.col("o_orderstatus") == "P", "status").when(F.col("s").isNull(), "no date")
    return dimensions.build_date_audit(t.orders.withColumn("s", s), F.col("s"), reason, "1999-01-01")


@query(f"WITH {DAILY_SQL} SELECT DISTINCT user_id, day, user_id % 5 AS place FROM daily WHERE user_id % 7 <> 0")
def mrt3_6_24_site_activity(t: Tables) -> DataFrame:
    rows = daily(t).withColumn("place", F.col("user_id") % 5)
    sites = dimensions.build_geography(rows, ["user_id", "day"], ["place"], F.col("user_id") % 7 != 0)
    active = dimensions.build_site_activity(rows.drop("place"), sites, ["user_id", "day"], ["user_id", "day", "place"])
    return dimensions.build_site_fact(active, ["user_id", "day", "place"], [F.col("day").desc()])


@query("""WITH r(kind, term, ord, label, relevant) AS (VALUES ('exact','part 7',1,'seven',true), ('substring','1',2,'ones',false), ('substring','9',3,'nines',true)),
h AS (SELECT p_partkey, p_brand, coalesce((SELECT min_by(label, CASE kind WHEN 'exact' THEN 0 ELSE 10 END + ord) FROM r WHERE (kind = 'exact' AND nm = term) OR (kind = 'substring' AND contains(nm, term))), 'unmapped') AS label FROM (SELECT p_partkey, p_brand, 'part ' || p_partkey AS nm FROM part))
SELECT p_brand, label, count(*) AS texts, min(CASE WHEN label = 'unmapped' THEN 'low' ELSE 'high' END) AS confidence FROM h GROUP BY 1, 2""")
def mrt4_rule_mapping(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([("exact", "part 7", 1, "seven"), ("substring", "1", 2, "ones"), ("substring", "9", 3, "nines")], "kind string, term string, ord int, label string")
    named = t.part.select("p_partkey", "p_brand", F.concat(F.lit("part "), "p_partkey").alias("nm"))
    mapped = R.tiered_rules(named, "nm", rules, "p_partkey").withColumn("label", F.coalesce("label", F.lit("unmapped")))
    return mapped.groupBy("p_brand", "label").agg(F.count("*").alias("texts"), F.min(F.when(F.col("label") == "unmapped", "low").otherwise("high")).alias("confidence"))


@query("""WITH s AS (SELECT user_id, ts::DATE AS day, md5(string_agg(event_id || ':' || event_type, '##' ORDER BY event_id)) AS h FROM events GROUP BY 1, 2), r AS (SELECT *, lag(h) OVER (PARTITION BY user_id ORDER BY day) AS before FROM s)
SELECT user_id, day FROM r WHERE before IS NOT NULL AND before <> h""")
def mrt12_outcome_set_changes(t: Tables) -> DataFrame:
    sets = dimensions.build_outcome_sets(t.events.withColumn("day", F.col("ts").cast("date")), ["user_id", "day"], ["event_id"], F.concat_ws(":", "event_id", "event_type"))
    return dimensions.build_outcome_changes(sets, ["user_id"], "day").select("user_id", "day")


@query(f"""WITH {HISTORY_SQL} SELECT user_id, day, event_type, CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id % 4 = 1 END AS has_mesh, event_type = 'error' AS unknown_status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS rn FROM history) WHERE rn = 1""")
def mrt14_dim_trial(t: Tables) -> DataFrame:
    k = F.col("user_id") % 4
    rows = dimensions.build_record_dimension(history(t), ["user_id"], "day", k != 0, {"unknown_status": F.col("event_type") == "error"}, k == 1)
    return rows.select("user_id", "day", "event_type", F.col("has_terms").alias("has_mesh"), "unknown_status")


@query("SELECT c_nationkey AS state, n_name, count(*) AS population FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20 GROUP BY 1, 2")
def mrt18_dim_population(t: Tables) -> DataFrame:
    return dimensions.build_population_dimension(t.customer, t.nation.where("n_nationkey < 20"), "c_nationkey", "n_nationkey", "n_name", F.count("*"))


@query("SELECT DISTINCT l_orderkey, l_suppkey, CASE WHEN l_linenumber = 1 THEN 'lead' ELSE 'other' END AS role FROM lineitem")
def mrt21_bridge_sponsor(t: Tables) -> DataFrame:
    return dimensions.build_sponsor_bridge(t.lineitem, "l_orderkey", "l_suppkey", F.when(F.col("l_linenumber") == 1, "lead").otherwise("other"))


@query("""WITH v AS (SELECT 'unique_l_orderkey_l_linenumber' AS "check", l_orderkey || '|' || l_linenumber AS item FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'accepted_o_orderstatus', o_orderstatus FROM (SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O','F'))
UNION ALL SELECT 'not_null_high', o_orderkey::VARCHAR FROM orders WHERE o_totalprice > 499000
UNION ALL SELECT 'related_n_nationkey', n_nationkey::VARCHAR FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 12)) SELECT * FROM v""")
def qc5_column_checks(t: Tables) -> DataFrame:
    high = t.orders.withColumn("high", F.when(F.col("o_totalprice") <= 499000, F.col("o_totalprice")))
    return quality.together(
        quality.unique(t.lineitem, ["l_orderkey", "l_linenumber"]), quality.accepted(t.orders, "o_orderstatus", ["O", "F"]), quality.not_null(high, "high", "o_orderkey"),
        quality.related(t.nation, "n_nationkey", t.supplier.where("s_nationkey < 12").withColumnRenamed("s_nationkey", "n_nationkey").select("n_nationkey"), "n_nationkey"),
    )


@query("""WITH k AS (SELECT l_suppkey, l_linenumber AS r, count(*) AS c FROM lineitem GROUP BY 1, 2) SELECT 'dense_r' AS "check", l_suppkey::VARCHAR AS item FROM k GROUP BY l_suppkey HAVING min(r) <> 1 OR max(r) <> count(*)
UNION ALL SELECT 'totals', coalesce(a.k, b.k)::VARCHAR FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n
UNION ALL SELECT 'nested_a_b', o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 100 > o_custkey % 100""")
def qc6_singular_checks(t: Tables) -> DataFrame:
    ranks = t.lineitem.select("l_suppkey", F.col("l_linenumber").alias("r")).distinct()
    one = t.orders.withColumn("one", F.lit(1))
    ab = t.orders.select("o_orderkey", (F.col("o_orderkey") % 100).alias("a"), (F.col("o_custkey") % 100).alias("b"))
    return quality.together(quality.dense_ranks(ranks, "l_suppkey", "r"), quality.equal_totals("totals", one.where("o_orderstatus <> 'P'"), one, "o_custkey", "one"), quality.nested(ab, F.col("o_orderkey"), "a", "b"))


@query(f"""WITH {HISTORY_SQL}, a AS (SELECT *, user_id % 2 AS scope, user_id % 3 AS grp, user_id % 5 AS state FROM history WHERE event_type = 'purchase'),
c AS (SELECT scope, day, date_diff('day', min(day) OVER (PARTITION BY scope), day) AS history_days, lag(day) OVER (PARTITION BY scope ORDER BY day) AS prev,
 first_value(day) OVER (PARTITION BY scope ORDER BY day RANGE BETWEEN INTERVAL 5 DAYS PRECEDING AND CURRENT ROW) AS f5, first_value(day) OVER (PARTITION BY scope ORDER BY day RANGE BETWEEN INTERVAL 10 DAYS PRECEDING AND CURRENT ROW) AS f10 FROM (SELECT DISTINCT user_id % 2 AS scope, day FROM history)),
s AS (SELECT scope, grp, state, day, min(previous_date) FILTER (WHERE entered) AS pred FROM a GROUP BY 1, 2, 3, 4),
w AS (SELECT s.*, history_days, prev, f5, f10, min(pred) OVER w5 AS e5, min(pred) OVER w10 AS e10 FROM s JOIN c USING (scope, day)
 WINDOW w5 AS (PARTITION BY scope, grp, state ORDER BY day RANGE BETWEEN INTERVAL 5 DAYS PRECEDING AND CURRENT ROW), w10 AS (PARTITION BY scope, grp, state ORDER BY day RANGE BETWEEN INTERVAL 10 DAYS PRECEDING AND CURRENT ROW)),
g AS (SELECT scope || '|' || grp || '|' || state || '|' || day AS item, history_days >= 5 AND f5 <= day - 5 + 2 AND prev >= day - 5 AND (e5 IS NULL OR e5 >= day - 5) AS ok5, history_days >= 10 AND f10 <= day - 10 + 2 AND prev >= day - 10 AND (e10 IS NULL OR e10 >= day - 10) AS ok10 FROM w)
SELECT 'unknown_5d' AS "check", item FROM g WHERE NOT coalesce(ok5, false) UNION ALL SELECT 'unknown_10d', item FROM g WHERE NOT coalesce(ok10, false)""")
def qc6_competition_guards(t: Tables) -> DataFrame:
    """No figure of the product may be given where a guard fails (no rows), and every row at which it must be unknown."""
    calendar, rows = history(t).select(F.pmod("user_id", F.lit(2)).alias("scope"), "day"), activity(t)
    out = H.competition(rows, calendar, ["scope"], ["grp", "state"], "user_id", "day", "entered", "previous_date", (5, 10), 10, tolerance=2)
    check = lambda name, value, n: quality.uncovered_windows(name, out, value, calendar, rows.where("entered"), ["scope"], ["grp", "state"], "day", "previous_date", n, 2)
    return quality.together(*(check(*c) for c in (("given_5d", "new_5d", 5), ("given_10d", "new_10d", 10), ("given_growth", "growth_10d", 10), ("unknown_5d", "active_count", 5), ("unknown_10d", "active_count", 10))))


@query("""WITH a AS (SELECT n_regionkey AS scope, c_nationkey AS area, o_orderpriority AS grp, o_orderdate::DATE AS day FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
m AS (SELECT DISTINCT scope, area, grp, date_trunc('month', day)::DATE AS month FROM a),
h AS (SELECT scope, month, date_diff('day', min(lo) OVER w, max(hi) OVER w) AS days FROM (SELECT scope, date_trunc('month', day)::DATE AS month, min(day) AS lo, max(day) AS hi FROM a GROUP BY 1, 2) WINDOW w AS (PARTITION BY scope ORDER BY month)),
x AS (SELECT m.*, days, min(m.month) OVER w AS base_month FROM m JOIN h USING (scope, month) WINDOW w AS (PARTITION BY scope, area, grp ORDER BY m.month RANGE BETWEEN INTERVAL 3 MONTHS PRECEDING AND CURRENT ROW))
SELECT 'unknown_growth' AS "check", scope || '|' || area || '|' || grp || '|' || month AS item FROM x WHERE NOT (days >= 90 AND base_month <= month - INTERVAL 3 MONTHS)""")
def qc6_trend_guards(t: Tables) -> DataFrame:
    """As qc6_competition_guards, for the growth of monthly trends."""
    rows = order_activity(t)
    population = t.customer.groupBy(F.col("c_nationkey").alias("area")).agg(F.count("*").alias("population"))
    out = H.monthly_trends(rows, ["scope"], ["area", "grp"], "o_orderkey", "day", population)
    check = lambda name, value: quality.ungrounded_growth(name, out, value, rows, ["scope"], ["area", "grp"], "day")
    return quality.together(check("given_growth", "growth"), check("unknown_growth", "n"))


@query("""SELECT 'orders have lines' AS "check", (SELECT count(*) FROM orders) AS expected, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS actual, (SELECT count(*) FROM orders) = (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS passed
UNION ALL SELECT 'line keys', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem WHERE l_orderkey IS NOT NULL), true""")
def qc1_2_reconciliation(t: Tables) -> DataFrame:
    n, m = t.orders.agg(F.count("*")), t.lineitem.agg(F.countDistinct("l_orderkey"))
    return quality.together(quality.reconciled("orders have lines", n, m), quality.reconciled("line keys", t.lineitem.agg(F.count("*")), t.lineitem.agg(F.count("l_orderkey"))))


@query("SELECT path, 'added' AS change FROM (SELECT DISTINCT unnest(json_keys(props)) AS path FROM events) WHERE path NOT IN ('a', 'b') UNION ALL SELECT 'a', 'removed' UNION ALL SELECT 'b', 'removed'")
def qc4_schema_drift(t: Tables) -> DataFrame:
    observed = t.events.select(F.explode(jsons.field_paths("props")).alias("path"))
    return quality.drift(observed, t.spark.createDataFrame([("a",), ("b",)], "path string"), "path")


@query(f"""WITH {HISTORY_SQL}, a AS (SELECT user_id % 3 AS grp, day, count(DISTINCT user_id) AS n FROM history WHERE event_type = 'purchase' GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY grp)::BIGINT AS purchases, row_number() OVER (PARTITION BY grp ORDER BY n DESC, day) AS rn FROM a) SELECT grp, purchases, n AS busiest, day AS first_busiest_day FROM r WHERE rn = 1""")
def qry23_rollup(t: Tables) -> DataFrame:
    per = reports.build_scoped_counts(activity(t), F.lit(True), F.col("grp"), "grp", "day", "user_id")
    return reports.build_rollup(per, ["grp"], "day", "n", ("purchases", "busiest", "first_busiest_day"))
