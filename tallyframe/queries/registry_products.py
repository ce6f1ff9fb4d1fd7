"""Registry products in full on stand-ins from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import quality
from ..operators.relational import concentration, strata
from ..plans import access, dimensions, reports
from ..plans import registry as plans
from ..registry import Tables, query

C = F.col
RUNS_SQL = """o AS (SELECT *, year(o_orderdate) AS run FROM orders),
runs AS (SELECT run, CASE WHEN run % 2 = 0 THEN 'even' ELSE 'odd' END AS profile, make_date(run, 12, 31) AS snapshot_date, CASE WHEN run % 5 = 0 THEN 'failed' ELSE 'success' END AS status, count(*) + (run % 3 = 0)::INT AS records FROM o GROUP BY run),
trials AS (SELECT run, o_custkey AS nct, o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'missing' ELSE 'ok' END AS quality, o_orderkey % 4 > 0 AS enrolled, o_orderkey % 5 > 0 AS started, o_orderkey % 6 > 0 AS sponsored, o_orderstatus AS status FROM o WHERE run < 2001),
places AS (SELECT run, o_custkey AS nct, l_suppkey, l_linenumber, l_returnflag, l_quantity FROM lineitem JOIN o ON o_orderkey = l_orderkey)"""


def _runs(t: Tables) -> DataFrame:
    years = t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return years.select(
        C("y").cast("string").alias("ingestion_run_id"), F.when(C("y") % 2 == 0, "even").otherwise("odd").alias("indication_profile_id"), F.make_date(C("y"), F.lit(12), F.lit(31)).alias("snapshot_date"),
        F.when(C("y") % 5 == 0, "failed").otherwise("success").alias("status"), (C("n") + (C("y") % 3 == 0).cast("int")).alias("record_count"),
    )


def _profile() -> Column:
    return F.when(F.year("o_orderdate") % 2 == 0, "even").otherwise("odd").alias("indication_profile_id")


def _trials(t: Tables) -> DataFrame:
    k, day = C("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.orders.where(F.year("o_orderdate") < 2001).select(
        F.year("o_orderdate").cast("string").alias("ingestion_run_id"), F.year("o_orderdate").cast("string").alias("snapshot_id"), _profile(), C("o_custkey").cast("string").alias("nct_id"),
        F.when(k % 9 == 0, "missing").otherwise("ok").alias("record_quality_flag"), F.when(k % 4 > 0, k).alias("enrollment_count"), F.when(k % 3 == 0, "ESTIMATED").when(k % 3 == 1, "ACTUAL").alias("enrollment_type"),
        F.when(k % 5 > 0, C("o_orderdate")).alias("start_date"), F.when(k % 6 > 0, "x").alias("lead_sponsor_normalized"), F.when(C("o_orderstatus") == "O", "RECRUITING").otherwise(C("o_orderstatus")).alias("overall_status"),
        F.when(k % 11 > 0, day).otherwise("soon").alias("last_update_post_date_raw"),
        F.when(k % 5 == 0, "").when(k % 5 == 1, F.substring(day, 1, 4)).when(k % 5 == 2, F.substring(day, 1, 7)).when(k % 5 == 3, day).otherwise("2020-13").alias("status_verified_date_raw"), k.alias("record"),
    )


def _places(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, C("o_orderkey") == C("l_orderkey"))
    n, q = C("l_linenumber"), C("l_quantity").cast("int")
    return rows.select(
        F.year("o_orderdate").cast("string").alias("ingestion_run_id"), F.year("o_orderdate").cast("string").alias("snapshot_id"), _profile(), C("o_custkey").cast("string").alias("nct_id"),
        (C("l_returnflag") == "R").alias("usable_geography_flag"), F.when(n % 2 == 0, 1.0).alias("latitude"), F.when(n % 4 == 0, 1.0).alias("longitude"), F.when(q % 3 == 0, " ").when(q % 3 == 1, "12345").alias("zip_code"),
        F.when(q % 2 == 0, "town").alias("city_normalized"), F.when(q % 5 == 0, "UNKNOWN").otherwise("S").alias("state_normalized"), F.when(q % 7 > 0, "US").alias("country"), (q % 2 == 0).alias("us_location_flag"),
        F.when(q % 11 > 0, "S").otherwise("").alias("state_raw"), F.when(q % 13 > 0, "f").alias("facility_name"), F.when(q % 4 == 0, "low").alias("mapping_confidence"),
    )


@query(f"""WITH {RUNS_SQL}, a AS (SELECT run, count(*) AS n, count(DISTINCT nct) AS d, count(*) FILTER (WHERE quality <> 'ok') AS f, count(*) FILTER (WHERE NOT enrolled) AS e, count(*) FILTER (WHERE NOT started) AS s, count(*) FILTER (WHERE NOT sponsored) AS l FROM trials GROUP BY run),
b AS (SELECT run, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS u, count(*) FILTER (WHERE l_linenumber % 4 = 0) AS x, count(*) FILTER (WHERE l_linenumber % 2 > 0 AND (l_quantity::INT % 3 = 1 OR (l_quantity::INT % 2 = 0 AND l_quantity::INT % 5 > 0))) AS y, count(*) FILTER (WHERE l_quantity::INT % 4 = 0) AS low FROM places GROUP BY run)
SELECT r.run::VARCHAR AS ingestion_run_id, profile AS indication_profile_id, snapshot_date, status, records AS manifest_record_count, a.n AS trial_row_count, a.d AS distinct_trial_count, a.n = records AS manifest_reconciled_flag, a.n = a.d AS unique_nct_flag, a.f AS flagged_record_count,
round(a.f / a.n, 8) AS flagged_record_share, round(a.e / a.n, 8) AS missing_enrollment_share, round(a.s / a.n, 8) AS missing_start_date_share, round(a.l / a.n, 8) AS missing_lead_sponsor_share, b.n AS location_row_count, b.u AS usable_location_count, b.x AS coordinates_exact_count, b.y AS coordinates_fallback_eligible_count,
round(b.u / b.n, 8) AS usable_location_share, round(b.x / b.n, 8) AS coordinates_exact_share, round(b.y / b.n, 8) AS coordinates_fallback_eligible_share, b.n AS condition_row_count, b.low AS low_confidence_condition_count, round(b.low / b.n, 8) AS low_confidence_condition_share
FROM runs r LEFT JOIN a USING (run) LEFT JOIN b USING (run)""")
def mrt37_run_reliability(t: Tables) -> DataFrame:
    places = _places(t)
    out = plans.build_run_reliability(_runs(t), _trials(t), places, places)
    return out.withColumns({c: F.round(c, 8) for c in out.columns if c.endswith("_share")})


@query(f"""WITH {RUNS_SQL}, g AS (SELECT run, nct, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS u, count(*) FILTER (WHERE l_quantity::INT % 7 = 0 OR (l_quantity::INT % 2 = 0 AND l_quantity::INT % 11 = 0)) AS m, count(*) FILTER (WHERE l_quantity::INT % 13 = 0) AS f FROM places GROUP BY ALL),
s AS (SELECT t.*, r.profile, r.snapshot_date, o_orderdate::DATE AS d, g.n, g.u, g.m, g.f, CASE WHEN g.u > 0 THEN 'usable' WHEN g.n IS NULL OR g.m > 0 THEN 'missing' ELSE 'unsupported' END AS geo, t.status = 'O' AS active FROM trials t JOIN orders USING (o_orderkey) JOIN runs r ON r.run = t.run AND r.status = 'success' LEFT JOIN g ON g.run = t.run AND g.nct = t.nct)
SELECT run::VARCHAR AS snapshot_id, profile AS indication_profile_id, nct::VARCHAR AS nct_id, run::VARCHAR AS ingestion_run_id, CASE WHEN status = 'O' THEN 'RECRUITING' ELSE status END AS overall_status, snapshot_date, CASE WHEN o_orderkey % 11 > 0 THEN d END AS posted_update_date,
CASE WHEN o_orderkey % 11 > 0 THEN snapshot_date - d END AS posted_update_age_days, CASE WHEN o_orderkey % 11 > 0 THEN snapshot_date - d > 180 END AS older_posted_update_flag, ['missing', 'year', 'month', 'day', 'unparseable'][o_orderkey % 5 + 1] AS verification_date_precision,
CASE WHEN o_orderkey % 5 IN (2, 3) THEN 12 - month(d) END AS verification_age_months, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey END AS enrollment_count, CASE WHEN o_orderkey % 4 = 0 THEN 'missing' WHEN o_orderkey % 3 = 0 THEN 'estimated' WHEN o_orderkey % 3 = 1 THEN 'actual' ELSE 'unknown_type' END AS enrollment_category,
coalesce(n, 0) AS recorded_location_count, coalesce(u, 0) AS usable_location_count, coalesce(m, 0) AS missing_geography_location_count, coalesce(f, 0) AS missing_facility_location_count, geo AS geography_category, active AS confirmed_recruiting_flag, active AND geo = 'usable' AS state_count_eligible_flag,
CASE WHEN NOT active THEN 'not_confirmed_recruiting' WHEN geo <> 'usable' THEN geo || '_geography' END AS state_count_exclusion_reason FROM s""")
def mrt38_study_audit(t: Tables) -> DataFrame:
    return plans.build_study_audit(_trials(t), _runs(t), _places(t)).drop("study_audit_key")


SEGMENTS_SQL = """obs AS (SELECT c_mktsegment AS profile, date_trunc('quarter', o_orderdate)::DATE AS day, o_custkey AS nct, o_orderpriority AS grp, n_name AS st, CASE o_custkey % 2 WHEN 0 THEN 'P1' ELSE 'P2' END AS ph, o_orderstatus AS status, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
comp AS (SELECT profile, day, grp, st, ph, count(DISTINCT nct) AS n FROM obs WHERE status = 'O' GROUP BY ALL),
stat AS (SELECT profile, day, nct, max(status) AS status FROM obs GROUP BY ALL)"""


def _observations(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, C("c_custkey") == C("o_custkey")).join(t.nation, C("n_nationkey") == C("c_nationkey"))
    return rows.select(
        C("c_mktsegment").alias("indication_profile_id"), F.date_trunc("quarter", "o_orderdate").cast("date").alias("snapshot_date"), C("o_custkey").alias("nct_id"), C("o_orderpriority").alias("condition_group"),
        C("n_name").alias("state_normalized"), F.when(C("o_custkey") % 2 == 0, "P1").otherwise("P2").alias("phase_normalized"), F.when(C("o_orderstatus") == "O", "RECRUITING").otherwise(C("o_orderstatus")).alias("overall_status"), C("o_orderkey").alias("record"),
    )


@query(f"""WITH {SEGMENTS_SQL}, nxt AS (SELECT profile, day, lead(day) OVER (PARTITION BY profile ORDER BY day) AS after FROM (SELECT DISTINCT profile, day FROM stat)),
bins AS (SELECT *, ntile(3) OVER (PARTITION BY profile, day, grp, ph ORDER BY n, st) AS b, min(n) OVER w AS lo, max(n) OVER w AS hi FROM comp WINDOW w AS (PARTITION BY profile, day, grp, ph)),
mem AS (SELECT DISTINCT profile, day, grp, st, ph, nct FROM obs WHERE status = 'O'),
r AS (SELECT b, x.nct IS NOT NULL AS seen, x.status FROM mem JOIN bins USING (profile, day, grp, st, ph) JOIN nxt USING (profile, day) LEFT JOIN stat x ON x.profile = mem.profile AND x.nct = mem.nct AND x.day = after WHERE hi > lo AND after IS NOT NULL)
SELECT ['low', 'mid', 'high'][b] AS density, count(*) AS n, count(*) FILTER (WHERE NOT seen) AS gone, round(count(*) FILTER (WHERE status = 'F') / nullif(count(*) FILTER (WHERE seen), 0), 8) AS finished, round(count(*) FILTER (WHERE status IN ('O', 'P')) / nullif(count(*) FILTER (WHERE seen), 0), 8) AS going_on, count(*) FILTER (WHERE seen) < 30 AS inconclusive FROM r GROUP BY b""")
def qry20_density_outcomes(t: Tables) -> DataFrame:
    rows = _observations(t)
    open_ = rows.where("overall_status = 'RECRUITING'")
    competition = open_.groupBy(*plans.SEGMENT, "snapshot_date").agg(F.countDistinct("nct_id").alias("recruiting_trial_count"))
    rank = F.when(C("overall_status") == "RECRUITING", "O").otherwise(C("overall_status"))
    statuses = rows.groupBy("indication_profile_id", "snapshot_date", "nct_id").agg(F.max(rank).alias("overall_status"))
    return plans.build_density_outcomes(competition, open_, statuses, {"finished": ("F",), "going_on": ("O", "P")}, 30)


@query(f"""WITH {SEGMENTS_SQL}, last AS (SELECT profile, max(day) AS day, count(DISTINCT day) > 1 AS several, max(day) - min(day) AS days FROM stat GROUP BY profile),
seg AS (SELECT o.profile, o.day, grp, st, ph, count(DISTINCT nct) AS n, count(DISTINCT nct % 7) AS owners, count(DISTINCT o_orderkey) AS sites, count(DISTINCT nct) FILTER (WHERE nct % 3 = 0) AS shared, count(DISTINCT nct) FILTER (WHERE o_orderkey % 4 > 0) AS good, any_value(several) AS several, any_value(days) AS days FROM obs o JOIN last l ON l.profile = o.profile AND l.day = o.day WHERE status = 'O' GROUP BY ALL),
f AS (SELECT *, CASE WHEN n % 2 = 0 THEN n END AS fresh, CASE WHEN owners >= 3 THEN 1.0::DOUBLE / owners END AS hhi, shared / n AS sh, 0.5::DOUBLE * (good / n) + 0.5::DOUBLE * CASE WHEN profile < 'C' THEN 0.25::DOUBLE ELSE 0 END AS complete FROM seg)
SELECT day AS snapshot_date, profile AS indication_profile_id, grp AS condition_group, st AS state_normalized, ph AS phase_normalized, n AS recruiting_trial_count, several AS has_multi_snapshot_history, days AS observed_history_days, round(sh, 8) AS site_overlap_share, round(complete, 8) AS operational_completeness_share,
n || ' recruiting listing(s) in segment; ' || CASE WHEN fresh IS NOT NULL THEN fresh || ' newly recruiting in 90 days (snapshot transitions; ' || days || ' days of history observed)' WHEN days < 90 THEN 'new recruiting: not enough history (' || days || ' of 90 days observed)' ELSE 'new recruiting: not enough history (snapshots do not cover the window)' END
|| '; ' || sites || ' newly registered within 90 days (registry first-post date, not a recruiting transition); ' || CASE WHEN hhi IS NULL THEN 'sponsor concentration: insufficient data (' || owners || ' sponsors)' ELSE 'sponsor concentration HHI ' || printf('%.2f', hhi) || ' across ' || owners || ' sponsor(s)' END
|| '; ' || round(sh * 100)::INT || '% of trials share a multi-trial facility listing; operational completeness ' || round(complete * 100)::INT || '%' AS priority_explanation FROM f""")
def mrt27_review_queue(t: Tables) -> DataFrame:
    rows = _observations(t)
    open_ = rows.where("overall_status = 'RECRUITING'")
    owners = F.countDistinct(C("nct_id") % 7)
    competition = open_.groupBy(*plans.SEGMENT, "snapshot_date").agg(F.countDistinct("nct_id").alias("recruiting_trial_count"), owners.alias("sponsor_count"), F.countDistinct("record").alias("listed_site_count"))
    n = C("recruiting_trial_count")
    competition = competition.withColumns({
        "new_recruiting_90d": F.when(n % 2 == 0, n), "newly_registered_90d": C("listed_site_count"), "sponsor_hhi": F.when(C("sponsor_count") >= 3, 1.0 / C("sponsor_count")), "top_sponsor_share": F.lit(None).cast("double"),
        "competition_signal_band": F.lit("low"),
    })
    sites = rows.withColumns({"facility_normalized": (C("nct_id") % 3).cast("string"), "city_normalized": F.lit(None).cast("string")})
    overlap = sites.select("indication_profile_id", "snapshot_date", "facility_normalized", "state_normalized").distinct().withColumns({"city_normalized": F.lit(""), "repeated_site_participation_flag": C("facility_normalized") == "0"})
    activity = rows.withColumn("record_quality_flag", F.when(C("record") % 4 > 0, "ok").otherwise("bad"))
    # of each profile the newest successful run counts; those after C have none
    profiles = rows.select("indication_profile_id").distinct()
    runs = profiles.withColumn("r", F.explode(F.expr("array(struct('a' id, date'2020-01-01' d, 0.9D s, 'success' t), struct('b' id, date'2020-01-02' d, 0.25D s, 'success' t), struct('c' id, date'2020-01-03' d, 0.7D s, 'failed' t))")))
    runs = runs.where("indication_profile_id < 'C'").select("indication_profile_id", C("r.id").alias("ingestion_run_id"), C("r.d").alias("snapshot_date"), C("r.s").alias("usable_location_share"), C("r.t").alias("status"))
    out = plans.build_review_queue(competition, rows.select("indication_profile_id", "snapshot_date"), sites, overlap, activity, runs)
    return out.select("snapshot_date", *plans.SEGMENT, "recruiting_trial_count", "has_multi_snapshot_history", "observed_history_days", *(F.round(c, 8).alias(c) for c in ("site_overlap_share", "operational_completeness_share")), "priority_explanation")


@query(f"""WITH {RUNS_SQL}, own AS (SELECT o_custkey % 400 AS seg, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1), p AS (SELECT l_partkey % 50 AS a, l_suppkey % 50 AS b, l_discount * 12 AS score, l_orderkey, l_linenumber FROM lineitem),
u AS (SELECT t.*, r.profile FROM trials t JOIN runs r USING (run)), w AS (SELECT profile, sum(CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey END) AS x FROM u GROUP BY 1), v AS (SELECT profile, sum(CASE WHEN u.o_orderkey % 4 > 0 THEN u.o_orderkey END) AS x FROM u JOIN places USING (run, nct) GROUP BY 1)
SELECT 'owners_hhi' AS "check", seg::VARCHAR AS item FROM own WHERE n = 2
UNION ALL SELECT 'bounded_score', concat_ws('|', l_orderkey, l_linenumber) FROM p WHERE score NOT BETWEEN 0 AND 1 UNION ALL SELECT 'self_pair_a_b', a::VARCHAR FROM p WHERE a = b
UNION ALL SELECT 'strata', 'priority' UNION ALL SELECT 'explained_eligible', o_orderkey::VARCHAR FROM trials WHERE o_orderkey % 97 = 0
UNION ALL SELECT 'enrollment', coalesce(w.profile, v.profile) FROM w FULL JOIN v ON w.profile = v.profile WHERE w.x IS DISTINCT FROM v.x
UNION ALL SELECT 'members', concat_ws('|', preset, k) FROM (SELECT DISTINCT CASE c_mktsegment WHEN 'BUILDING' THEN 'p' ELSE 'unassigned' END AS preset, c_custkey AS k FROM customer) WHERE preset = 'unassigned' AND k % 13 = 0
UNION ALL SELECT 'unique_nct_id_snapshot_id', nct || '|' || run FROM trials GROUP BY nct, run HAVING count(*) > 1""")
def qc6_product_checks(t: Tables) -> DataFrame:
    owners = concentration(t.orders.withColumn("seg", C("o_custkey") % 400), ["seg"], "o_orderpriority", F.count("*"), 2)  # too few for the rule of three
    pairs = t.lineitem.select((C("l_partkey") % 50).alias("a"), (C("l_suppkey") % 50).alias("b"), (C("l_discount") * 12).alias("score"), "l_orderkey", "l_linenumber")
    parts = strata(t.orders, {"status": C("o_orderstatus"), "priority": C("o_orderpriority")}, [F.count("*").alias("n")]).where("stratum <> '5-LOW'")
    trials, places = _trials(t), _places(t)
    audited = trials.select(C("record").alias("key"), (C("record") % 2 == 0).alias("eligible"), F.when((C("record") % 2 == 1) != (C("record") % 97 == 0), "why").alias("reason"))
    after = trials.join(places.select("ingestion_run_id", "nct_id"), ["ingestion_run_id", "nct_id"])
    presets = t.spark.createDataFrame([("p", "building")], "preset string, term string")
    members = dimensions.build_membership(t.customer, "c_custkey", C("c_mktsegment"), presets)
    kept = members.where("preset = 'p' OR c_custkey % 13 > 0")
    return quality.together(
        quality.enough_owners(owners, "hhi", "owners", ["seg"]), quality.bounded(pairs, "score", 0.0, 1.0, ["l_orderkey", "l_linenumber"]), quality.no_self_pairs(pairs, "a", "b"),
        quality.parts_of_whole("strata", parts, "stratum_type", "n", t.orders.agg(F.count("*").alias("n"))), quality.explained(audited, "eligible", "reason", C("key")),
        quality.unchanged_by_join("enrollment", trials, after, "indication_profile_id", "enrollment_count"), quality.members_hold("members", kept, "c_custkey", members, "preset"),
        quality.unique(trials, ["nct_id", "snapshot_id"]),
    )


@query(f"""WITH {RUNS_SQL}, a AS (SELECT run, count(*) FILTER (WHERE quality <> 'ok') / count(*) AS s FROM trials GROUP BY run)
SELECT profile AS indication_profile_id, snapshot_date, round(s, 8) AS flagged_record_share, round(s - lag(s) OVER (PARTITION BY profile ORDER BY snapshot_date), 8) AS change FROM runs LEFT JOIN a USING (run)""")
def qry14_registry_reliability_trend(t: Tables) -> DataFrame:
    places = _places(t)
    return reports.build_grouped_trend(plans.build_run_reliability(_runs(t), _trials(t), places, places), "indication_profile_id", "snapshot_date", "flagged_record_share")


@query(f"""WITH {SEGMENTS_SQL}, s AS (SELECT profile, day, st, nct % 3 AS facility, count(DISTINCT nct) AS n_keys, array_to_string(list_sort(list(DISTINCT grp)), ', ') AS mix FROM obs GROUP BY ALL HAVING count(DISTINCT nct) >= 2)
SELECT * FROM s ORDER BY n_keys DESC, profile, day, st, facility LIMIT 50""")
def qry14_overlap_hotspots(t: Tables) -> DataFrame:
    rows = _observations(t).select(C("indication_profile_id").alias("profile"), C("snapshot_date").alias("day"), C("state_normalized").alias("st"), (C("nct_id") % 3).alias("facility"), C("nct_id").alias("k"), "condition_group")
    spots = access.overlap_hotspots(rows, ["profile", "day", "st", "facility"], "k", "condition_group")
    return reports.build_top_rows(spots, spots.columns, [C("n_keys").desc(), C("profile"), C("day"), C("st"), C("facility")], 50)


@query(f"""WITH {SEGMENTS_SQL}, n AS (SELECT o.profile, grp, st, ph, count(DISTINCT nct) AS n, count(DISTINCT nct % 7) AS owners FROM obs o JOIN (SELECT profile, max(day) AS day FROM stat GROUP BY 1) l ON l.profile = o.profile AND l.day = o.day WHERE status = 'O' GROUP BY ALL)
SELECT * FROM n ORDER BY n DESC, owners DESC, profile, grp, st, ph LIMIT 25""")
def qry14_top_segments(t: Tables) -> DataFrame:
    rows = _observations(t)
    newest = rows.groupBy("indication_profile_id").agg(F.max("snapshot_date").alias("snapshot_date"))
    open_ = rows.join(newest, ["indication_profile_id", "snapshot_date"], "left_semi").where("overall_status = 'RECRUITING'")
    names = dict(zip(plans.SEGMENT, ("profile", "grp", "st", "ph"), strict=True))
    counts = open_.groupBy(*(C(c).alias(n) for c, n in names.items())).agg(F.countDistinct("nct_id").alias("n"), F.countDistinct(C("nct_id") % 7).alias("owners"))
    return reports.build_top_rows(counts, counts.columns, [C("n").desc(), C("owners").desc(), *map(C, names.values())], 25)


@query("""WITH d AS (SELECT c_nationkey AS region, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'status' WHEN c_acctbal < 0 THEN 'balance' ELSE 'included' END AS category FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT region, category, count(DISTINCT o_custkey) AS n, count(DISTINCT o_custkey) AS recount, true AS agrees FROM d GROUP BY 1, 2""")
def qry22_case_study_recount(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, C("c_custkey") == C("o_custkey"))
    category = F.when(C("o_orderstatus") == "P", "status").when(C("c_acctbal") < 0, "balance").otherwise("included")
    rows = rows.select(C("c_nationkey").alias("region"), category.alias("category"), "o_custkey")
    counts = rows.groupBy("region", "category").agg(F.countDistinct("o_custkey").alias("n"))
    # anew, from customers: each category by a semi-join of its own
    orders = t.orders.select(C("o_custkey").alias("c_custkey"), (C("o_orderstatus") == "P").alias("p"))
    parts = {"status": t.customer.join(orders.where("p"), "c_custkey", "left_semi"), "balance": t.customer.where("c_acctbal < 0").join(orders.where("NOT p"), "c_custkey", "left_semi"),
             "included": t.customer.where("c_acctbal >= 0 OR c_acctbal IS NULL").join(orders.where("NOT p"), "c_custkey", "left_semi")}
    again = [df.groupBy(C("c_nationkey").alias("region")).agg(F.count("*").alias("n")).withColumn("category", F.lit(name)) for name, df in parts.items()]
    return reports.build_recount(counts, again[0].unionByName(again[1]).unionByName(again[2]), ["region", "category"], "n")


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderpriority AS grp, count(*) AS n, count(DISTINCT o_custkey) AS k FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
p AS (SELECT p_partkey AS a, lead(p_partkey) OVER (PARTITION BY p_name, p_type ORDER BY p_partkey) AS b FROM part), r AS (SELECT c_nationkey AS nation, count(o_orderkey) / count(DISTINCT c_custkey) AS rate FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT 'latest_month' AS page, month || '|' || grp AS item, sum(n)::DOUBLE AS value FROM m WHERE grp < '4' AND month = (SELECT max(month) FROM m WHERE grp < '4') GROUP BY month, grp
UNION ALL SELECT 'matches', concat_ws('|', a, b, x.p_brand, y.p_brand), y.p_size::DOUBLE FROM p JOIN part x ON x.p_partkey = a LEFT JOIN part y ON y.p_partkey = b AND b % 10 > 0 WHERE b IS NOT NULL
UNION ALL SELECT 'top_rates', nation::VARCHAR, round(rate, 6) FROM (SELECT * FROM r ORDER BY rate DESC, nation LIMIT 20)""")
def qry23_page_views(t: Tables) -> DataFrame:
    monthly = t.orders.where("o_orderstatus <> 'P'").groupBy(F.trunc("o_orderdate", "month").alias("month"), C("o_orderpriority").alias("grp")).agg(F.count("*").alias("n"))
    latest = reports.build_latest_month(monthly, "month", ["grp"], ["n"], C("grp") < "4")
    following = F.lead("p_partkey").over(Window.partitionBy("p_name", "p_type").orderBy("p_partkey"))
    pairs = t.part.select(C("p_partkey").alias("k"), following.alias("b")).where("b IS NOT NULL")
    records = t.part.select(C("p_partkey").alias("k"), "p_brand", "p_size")
    shown = reports.build_matches_shown(pairs, records.where("k % 10 > 0"), "k", "b", ["p_brand", "p_size"]).join(records.select("k", C("p_brand").alias("own_brand")), "k")
    rates = t.customer.join(t.orders, C("o_custkey") == C("c_custkey"), "left").groupBy(C("c_nationkey").alias("nation")).agg((F.count("o_orderkey") / F.countDistinct("c_custkey")).alias("rate"))
    top = reports.build_top_rows(rates, ["nation", "rate"], [C("rate").desc(), C("nation")], 20)
    row = lambda page, item, value: (F.lit(page).alias("page"), item.alias("item"), value.cast("double").alias("value"))
    return (
        latest.select(*row("latest_month", F.concat_ws("|", C("month").cast("string"), "grp"), C("n")))
        .unionByName(shown.select(*row("matches", F.concat_ws("|", C("k").cast("string"), C("b").cast("string"), "own_brand", "match_p_brand"), C("match_p_size"))))
        .unionByName(top.select(*row("top_rates", C("nation").cast("string"), F.round("rate", 6))))
    )
