"""Indexes, bitmaps, intervals, running sums, nearest places and search on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import variants
from ..operators import bitmaps, intervals, nearest, quality, running, term_index
from ..operators.stages import shared_folder
from ..plans import reports, search
from ..plans.similarity import Factor, build_related, build_top_matches, overlap
from ..registry import Tables, query
from .windowed import DAILY_SQL, daily

SEGMENTS_SQL = """s AS (SELECT o_orderpriority AS priority, o_orderstatus AS status, year(o_orderdate)::INTEGER AS year, o_custkey AS key FROM orders),
scopes AS (SELECT DISTINCT priority, CASE WHEN priority < '3' THEN 'urgent' ELSE 'rest' END AS scope FROM s UNION ALL SELECT DISTINCT priority, 'all' FROM s)"""


@query(f"WITH {SEGMENTS_SQL} SELECT scope, year, count(DISTINCT key) AS customers, count(DISTINCT key) FILTER (WHERE status = 'O') AS active FROM s JOIN scopes USING (priority) GROUP BY ALL")
def agg21_bitmaps_of_scopes(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("key"))
    bits, _ = bitmaps.build_key_bitmaps(rows, ["priority", "status", "year"], "key")
    priorities = rows.select("priority").distinct()
    scopes = priorities.withColumn("scope", F.when(F.col("priority") < "3", "urgent").otherwise("rest")).unionByName(priorities.withColumn("scope", F.lit("all")))
    return bitmaps.distinct_in(bits.join(scopes, "priority"), ["scope", "year"], {"customers": F.lit(True), "active": F.col("status") == "O"})


INTERVALS_SQL = f"""{DAILY_SQL}, c AS (SELECT day, lead(day) OVER (ORDER BY day) AS next FROM (SELECT DISTINCT day FROM daily)),
l AS (SELECT user_id, day, event_type, next, lag(next) OVER w IS DISTINCT FROM day OR lag(event_type) OVER w IS DISTINCT FROM event_type AS opens FROM daily JOIN c USING (day) WINDOW w AS (PARTITION BY user_id ORDER BY day)),
r AS (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY user_id ORDER BY day) AS run FROM l),
spans AS (SELECT user_id, any_value(event_type) AS event_type, min(day) AS valid_from, max_by(next, day) AS valid_to FROM r GROUP BY user_id, run)"""


@query(f"WITH {INTERVALS_SQL} SELECT user_id, event_type, valid_from, CASE WHEN valid_from < (SELECT max(day) FROM daily) THEN valid_to END AS valid_to FROM spans".replace("max_by(next, day)", "max_by(coalesce(next, DATE '9999-01-01'), day)").replace("THEN valid_to END", "AND valid_to < DATE '9999-01-01' THEN valid_to END"))
def mrt1_validity_intervals(t: Tables) -> DataFrame:
    return intervals.build_intervals(daily(t), ["user_id"], "day", ["event_type"])


@query(f"WITH {DAILY_SQL}, p AS (SELECT event_id, user_id, ts::DATE AS day FROM events), c AS (SELECT day FROM daily GROUP BY 1) SELECT event_id, event_type AS state FROM p JOIN daily USING (user_id, day)")
def mrt23_events_in_their_intervals(t: Tables) -> DataFrame:
    points = t.events.select("event_id", "user_id", F.col("ts").cast("date").alias("at"))
    spans = intervals.build_intervals(daily(t), ["user_id"], "day", ["event_type"])
    return intervals.at_their_days(points, spans, ["user_id"], "at", F.lit("2100-01-01").cast("date")).select("event_id", F.col("event_type").alias("state"))


@query("""SELECT o_orderkey, row_number() OVER w AS place, lag(o_orderstatus) OVER w AS before, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING) / sum(o_totalprice) OVER (), 8) AS share
FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)""")
def win16_running_share(t: Tables) -> DataFrame:
    total = t.orders.agg(F.sum("o_totalprice").alias("total"))
    rows = running.running_over_all(t.orders, ["o_orderdate", "o_orderkey"], {"upto": F.col("o_totalprice")}, "place", {"before": "o_orderstatus"})
    return rows.crossJoin(F.broadcast(total)).select("o_orderkey", "place", "before", F.round(F.col("upto") / F.col("total"), 8).alias("share"))  # the total is one row


def _names(t: Tables) -> DataFrame:
    other = F.concat_ws(" ", "p_type", "p_brand")
    both = F.array(F.struct(F.col("p_name").alias("name"), F.lit(True).alias("main")), F.struct(other.alias("name"), F.lit(False).alias("main")))
    return t.part.select(F.col("p_partkey").alias("concept"), F.explode(both).alias("n")).select("concept", "n.name", "n.main")


def _indexed(t: Tables) -> str:
    root = f"{shared_folder(t.spark)}/term-index-{uuid.uuid4().hex}"
    term_index.build_term_index(_names(t), root)
    return root


NAMES_SQL = "n AS (SELECT p_partkey AS concept, p_name AS name, true AS main FROM part UNION ALL SELECT p_partkey, p_type || ' ' || p_brand, false FROM part)"


@query(f"""WITH {NAMES_SQL}, s AS (SELECT *, CASE WHEN lower(name) = 'econ' THEN 100 WHEN starts_with(lower(name), 'econ') THEN 80 WHEN contains(' ' || lower(name), ' econ') THEN 65 WHEN contains(lower(name), 'econ') THEN 50 ELSE 0 END - CASE WHEN main THEN 0 ELSE 10 END AS score FROM n WHERE contains(lower(name), 'econ'))
SELECT concept, max(score)::INTEGER AS score, min(name) FILTER (WHERE main) AS term FROM s GROUP BY 1 ORDER BY score DESC, length(term), term, concept LIMIT 500""")
def qry6_indexed_search(t: Tables) -> DataFrame:
    return term_index.search_index(t.spark, _indexed(t), "Econ", 500)


@query(f"WITH {NAMES_SQL} SELECT concept, name FROM n WHERE contains(lower(name), 'y brand#1')")
def fil7_indexed_contains(t: Tables) -> DataFrame:
    return term_index.containing(t.spark, _indexed(t), "Y Brand#1").select("concept", "name")


PLACES_SQL = """p AS (SELECT c_custkey AS point, ((c_custkey * 37) % 1700) / 10.0::DOUBLE - 85 AS lat, ((c_custkey * 101) % 3590) / 10.0::DOUBLE - 179 AS lon FROM customer),
s AS (SELECT s_suppkey AS place, ((s_suppkey * 53) % 170)::DOUBLE - 85 AS place_lat, ((s_suppkey * 79) % 359)::DOUBLE - 179 AS place_lon FROM supplier)"""


@query(f"""WITH {PLACES_SQL}, d AS (SELECT point, place, 2*3958.8*asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(place_lat - lat)/2),2) + cos(radians(lat))*cos(radians(place_lat))*pow(sin(radians(place_lon - lon)/2),2))))) AS miles FROM p, s)
SELECT point, rank, place, round(miles, 4) AS miles FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY miles, place)::INTEGER AS rank FROM d) WHERE rank <= 3""")
def join17_nearest_places(t: Tables) -> DataFrame:
    at = lambda key, a, m, d: F.pmod(F.col(key) * a, F.lit(m)) / F.lit(d)
    points = t.customer.select(F.col("c_custkey").alias("point"), (at("c_custkey", 37, 1700, 10.0) - 85).alias("lat"), (at("c_custkey", 101, 3590, 10.0) - 179).alias("lon"))
    places = t.supplier.select(F.col("s_suppkey").alias("place"), (at("s_suppkey", 53, 170, 1.0) - 85).alias("place_lat"), (at("s_suppkey", 79, 359, 1.0) - 179).alias("place_lon"))
    return nearest.nearest_places(points, places, 3, 256.0).select("point", "rank", "place", F.round("miles", 4).alias("miles"))


FACTORS = (
    Factor("same_condition", 0.3, holds=overlap("groups")), Factor("same_phase", 0.2, ("p_type",)), Factor("geography_overlap", 0.15, holds=overlap("nations")), Factor("intervention_type_overlap", 0.1, ("p_brand",)),
    Factor("study_design_match", 0.1, ("price_band",)), Factor("eligibility_compatible", 0.1, holds=lambda a, b: F.abs(a("p_size") - b("p_size")) <= 10), Factor("enrollment_band_match", 0.05, ("size_band",)),
)
_SCORE_SQL = " + ".join(f"{f.weight}::DOUBLE * {f.name}" for f in FACTORS)


@query(f"""WITH s AS (SELECT l_partkey, list_sort(list(DISTINCT s_nationkey)) AS nations FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1),
f AS (SELECT p_partkey AS k, string_split(p_name, ' ') AS groups, p_type, p_brand, p_size, floor(p_retailprice / 10) AS price_band, p_size // 10 AS size_band, coalesce(nations, []) AS nations, [p_name, p_brand || '|' || p_type] AS tokens FROM part LEFT JOIN s ON l_partkey = p_partkey),
u AS (SELECT k, unnest(tokens) AS tok FROM f), m AS (SELECT tok FROM u GROUP BY 1 HAVING count(*) < 2000), c AS (SELECT DISTINCT x.k AS a, y.k AS b FROM u x JOIN u y USING (tok) JOIN m USING (tok) WHERE x.k <> y.k),
r AS (SELECT a, b, list_has_any(x.groups, y.groups)::INT AS same_condition, (x.p_type = y.p_type)::INT AS same_phase, list_has_any(x.nations, y.nations)::INT AS geography_overlap, (x.p_brand = y.p_brand)::INT AS intervention_type_overlap,
(x.price_band = y.price_band)::INT AS study_design_match, (abs(x.p_size - y.p_size) <= 10)::INT AS eligibility_compatible, (x.size_band = y.size_band)::INT AS enrollment_band_match FROM c JOIN f x ON x.k = a JOIN f y ON y.k = b),
q AS (SELECT *, round({_SCORE_SQL}, 4) AS score FROM r)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b)::INTEGER AS rank FROM q) WHERE rank <= 25""")
def mrt10_top_25_by_seven_factors(t: Tables) -> DataFrame:
    nations = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sort_array(F.collect_set("s_nationkey")).alias("nations"))
    features = t.part.join(nations, "p_partkey", "left").select(
        F.col("p_partkey").alias("a"), F.split("p_name", " ").alias("groups"), "p_type", "p_brand", "p_size", F.floor(F.col("p_retailprice") / 10).alias("price_band"), F.floor(F.col("p_size") / 10).alias("size_band"),
        F.coalesce("nations", F.array().cast("array<long>")).alias("nations"), F.array("p_name", F.concat_ws("|", "p_brand", "p_type")).alias("tokens"),
    )
    return build_top_matches(features, "a", "tokens", FACTORS).withColumnRenamed("match", "b").drop("shared")


@query(f"""WITH s AS (SELECT l_partkey, list_sort(list(DISTINCT s_nationkey)) AS nations FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1),
f AS (SELECT p_partkey AS k, p_type, p_brand, p_size, floor(p_retailprice / 10) AS price_band, p_size // 10 AS size_band, coalesce(nations, []) AS nations, p_brand || '|' || p_size AS grp, string_split(p_name, ' ') AS w FROM part LEFT JOIN s ON l_partkey = p_partkey),
m AS (SELECT k, w[1] AS term, false AS up FROM f UNION ALL SELECT k, w[2], true FROM f UNION ALL SELECT k, p_type, true FROM f WHERE k % 3 = 0), x AS (SELECT k AS target FROM f WHERE k % 50 = 0),
c AS (SELECT target, y.k, 1 AS g, 0 AS d FROM x JOIN f z ON z.k = target JOIN f y USING (grp) UNION ALL SELECT target, n.k, 0, CASE WHEN NOT o.up AND NOT n.up THEN 2 ELSE 1 END FROM x JOIN m o ON o.k = target JOIN m n USING (term) WHERE NOT (o.up AND n.up)),
p AS (SELECT target, k, max(g) AS g, max(d) AS d FROM c WHERE k <> target GROUP BY ALL), q AS (SELECT p.*, row_number() OVER (PARTITION BY target ORDER BY (a.p_type = b.p_type) DESC, g DESC, d DESC, p.k) AS n FROM p JOIN f a ON a.k = target JOIN f b ON b.k = p.k),
r AS (SELECT target, q.k AS p_partkey, g AS same_condition, (a.p_type = b.p_type)::INT AS same_phase, list_has_any(a.nations, b.nations)::INT AS geography_overlap, (a.p_brand = b.p_brand)::INT AS intervention_type_overlap, (a.price_band = b.price_band)::INT AS study_design_match,
(abs(a.p_size - b.p_size) <= 10)::INT AS eligibility_compatible, (a.size_band = b.size_band)::INT AS enrollment_band_match FROM q JOIN f a ON a.k = target JOIN f b ON b.k = q.k WHERE n <= 100),
z AS (SELECT *, round({_SCORE_SQL}, 4) AS score FROM r) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, p_partkey)::INTEGER AS rank FROM z WHERE score >= 0.3) WHERE rank <= 10""")
def qry3_related_by_groups_and_terms(t: Tables) -> DataFrame:
    nations = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sort_array(F.collect_set("s_nationkey")).alias("nations"))
    features = t.part.join(nations, "p_partkey", "left").select(
        "p_partkey", "p_type", "p_brand", "p_size", F.floor(F.col("p_retailprice") / 10).alias("price_band"), F.floor(F.col("p_size") / 10).alias("size_band"), F.coalesce("nations", F.array().cast("array<long>")).alias("nations")
    )
    groups = t.part.select("p_partkey", F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("group"))
    word, row = F.split("p_name", " "), lambda term, up: F.struct(term.alias("term"), F.lit(up).alias("is_ancestor"))
    listed = F.array_compact(F.array(row(word[0], False), row(word[1], True), F.when(F.col("p_partkey") % 3 == 0, row(F.col("p_type"), True))))
    terms = t.part.select("p_partkey", F.explode(listed).alias("m")).select("p_partkey", "m.term", "m.is_ancestor")
    return build_related(features, t.part.where("p_partkey % 50 = 0"), "p_partkey", groups, terms, "p_type", FACTORS, 10, 100, 0.3).drop("shared")


LISTED_SQL = """t AS (SELECT o_orderkey AS k, o_orderpriority AS title, o_orderstatus AS status, CASE o_custkey % 3 WHEN 0 THEN 'P1' WHEN 1 THEN 'P1/P2' END AS phase, CASE WHEN o_custkey % 5 > 0 THEN 40 + o_custkey % 50 END AS max_age,
CASE o_custkey % 4 WHEN 0 THEN 'ALL' WHEN 1 THEN 'FEMALE' WHEN 2 THEN 'MALE' END AS sex, o_custkey % 2 = 0 AS healthy, o_orderdate::DATE AS started, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate::DATE + 30 END AS updated, c_mktsegment AS class FROM orders JOIN customer ON c_custkey = o_custkey),
x AS (SELECT DISTINCT l_orderkey AS k, s_suppkey AS n, s_name AS facility, CASE WHEN s_suppkey % 2 = 0 THEN 25.0::DOUBLE + s_nationkey WHEN s_suppkey % 3 = 0 THEN 40.0 + s_nationkey ELSE 10.0 + n_regionkey END AS lat,
CASE WHEN s_suppkey % 2 = 0 THEN -120.0::DOUBLE + 2 * s_nationkey WHEN s_suppkey % 3 = 0 THEN -90.0 ELSE -80.0 END AS lon FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_linestatus = 'O')"""
TRIALS_SQL = f"""{LISTED_SQL},
y AS (SELECT k, min(struct_pack(miles, n, facility)) AS s FROM (SELECT *, 2*3958.8*asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(lat - 30.0)/2),2) + cos(radians(30.0))*cos(radians(lat))*pow(sin(radians(lon + 100.0)/2),2))))) AS miles FROM x) GROUP BY k),
g AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT p_name)) AS conditions, bool_or(contains(lower(p_name), 'cold')) AS cold, bool_or(p_type = 'ECONOMY') AS economy FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
j AS (SELECT t.*, g.conditions, coalesce(cold, false) AS cold, coalesce(economy, false) AS economy, y.s.miles AS miles, y.s.facility AS facility, (SELECT min(struct_pack(n, facility)) FROM x WHERE x.k = t.k).facility AS first_facility FROM t LEFT JOIN g USING (k) LEFT JOIN y USING (k)),
a AS (SELECT 1 AS page, k, first_facility AS facility, NULL::DOUBLE AS miles, conditions, class, count(*) OVER () AS total, row_number() OVER (ORDER BY updated DESC NULLS LAST, k DESC) AS rn FROM j WHERE status = 'F' AND phase = 'P1/P2' AND cold
UNION ALL SELECT 2, k, facility, round(miles, 6), conditions, class, count(*) OVER (), row_number() OVER (ORDER BY miles, k) FROM j WHERE miles <= 900 AND coalesce(max_age >= 60, true) AND coalesce(sex, 'ALL') IN ('ALL', 'MALE')
UNION ALL SELECT 3, k, first_facility, NULL, conditions, class, count(*) OVER (), row_number() OVER (ORDER BY started, k) FROM j WHERE class = 'FURNITURE' AND economy AND healthy AND updated >= DATE '1997-01-01')"""


def _search_tables(t: Tables) -> tuple[DataFrame, ...]:
    """Trials, sited sites, sponsors, interventions, conditions and terms."""
    k, c = F.col("o_custkey"), F.col
    trials = t.orders.join(t.customer.select("c_custkey"), c("c_custkey") == k).select(
        c("o_orderkey").alias("nct_id"), c("o_orderpriority").alias("brief_title"), c("o_orderstatus").alias("overall_status"), F.when(k % 3 == 0, "P1").when(k % 3 == 1, "P1/P2").alias("phase"), F.lit(None).cast("double").alias("min_age_years"),
        F.when(k % 5 > 0, 40 + k % 50).alias("max_age_years"), F.when(k % 4 == 0, "ALL").when(k % 4 == 1, "FEMALE").when(k % 4 == 2, "MALE").alias("sex_eligibility"), (k % 2 == 0).alias("accepts_healthy_volunteers"),
        F.array("o_orderpriority").alias("std_age_groups"), c("o_orderdate").cast("date").alias("start_date"), F.when(c("o_orderkey") % 7 > 0, F.date_add("o_orderdate", 30)).alias("last_update_post_date"),
    )
    own, by_zip = c("s_suppkey") % 2 == 0, c("s_suppkey") % 3 == 0
    listed = t.lineitem.where("l_linestatus = 'O'").select("l_orderkey", "l_suppkey").distinct().join(t.supplier, c("s_suppkey") == c("l_suppkey")).join(t.nation, c("n_nationkey") == c("s_nationkey"))
    sites = listed.select(
        c("l_orderkey").alias("nct_id"), c("s_suppkey").alias("location_ordinal"), c("s_name").alias("facility_name"), c("n_name").alias("city"), c("n_name").alias("city_normalized"), c("n_regionkey").cast("string").alias("state_normalized"),
        F.when(by_zip, F.lpad(c("s_nationkey").cast("string"), 5, "0")).alias("zip_code"), F.when(own, 25.0 + c("s_nationkey")).alias("latitude"), F.when(own, -120.0 + 2 * c("s_nationkey")).alias("longitude"), F.lit("Recruiting").alias("location_status"),
    )
    zips = t.nation.select(F.lpad(c("n_nationkey").cast("string"), 5, "0").alias("zip"), (40.0 + c("n_nationkey")).alias("latitude"), F.lit(-90.0).alias("longitude"))
    cities = t.nation.select(c("n_regionkey").cast("string").alias("state"), c("n_name").alias("city_name"), F.lit(None).cast("string").alias("city_name_stripped"), (10.0 + c("n_regionkey")).alias("latitude"), F.lit(-80.0).alias("longitude"))
    sponsors = t.orders.join(t.customer, c("c_custkey") == k).select(c("o_orderkey").alias("nct_id"), c("c_mktsegment").alias("sponsor_class"), F.lit("lead_sponsor").alias("sponsor_role"))
    parts = t.lineitem.select(c("l_orderkey").alias("nct_id"), "l_partkey").join(t.part, c("p_partkey") == c("l_partkey"))
    conditions = parts.select("nct_id", c("p_name").alias("condition_raw"), F.lit(None).cast("string").alias("condition_group"), c("p_name").alias("condition_normalized"))
    terms = parts.select("nct_id", c("p_brand").alias("mesh_term"), c("p_brand").alias("mesh_id"))
    return (trials, search.sited(sites, zips, cities), sponsors, parts.select("nct_id", c("p_type").alias("intervention_type")), conditions, terms)


@query(f"WITH {TRIALS_SQL} SELECT page, k, facility, miles, array_to_string(conditions, ',') AS conditions, class, total FROM a WHERE rn <= 41")
def qry1_search_filter_sets(t: Tables) -> DataFrame:
    tables, c = _search_tables(t), F.col
    wanted = [
        search.Wanted(status="f", phase="p2", condition="Cold", size=40), search.Wanted(place=(30.0, -100.0), radius_miles=900.0, min_age=60, sex="Male", sort="distance", size=40),
        search.Wanted(sponsor_class="FURNITURE", intervention_type="economy", healthy_volunteers=True, updated_since="1997-01-01", sort="start_date", size=40),
    ]
    pages = [search.build_search(*tables, w).withColumn("page", F.lit(n)) for n, w in enumerate(wanted, 1)]
    rows = pages[0].unionByName(pages[1]).unionByName(pages[2])
    return rows.select("page", c("nct_id").alias("k"), c("nearest_facility_name").alias("facility"), F.round("distance_miles", 6).alias("miles"), F.array_join("conditions", ",").alias("conditions"), c("sponsor_class").alias("class"), "total")


@query(f"""WITH {LISTED_SQL},
d AS (SELECT k, n, CASE WHEN n % 2 = 0 THEN 'registry' WHEN n % 3 = 0 THEN 'zip' ELSE 'city' END AS source, round(2*3958.8*asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(lat - 30.0)/2),2) + cos(radians(30.0))*cos(radians(lat))*pow(sin(radians(lon + 100.0)/2),2))))), 1) AS miles FROM x)
SELECT t.k, coalesce(string_agg(concat_ws(':', n, source, (miles * 10)::BIGINT), ';' ORDER BY n), '') AS sites FROM t LEFT JOIN d USING (k) GROUP BY t.k""")
def qry2_details_with_site_distances(t: Tables) -> DataFrame:
    trials, sites, *_ = _search_tables(t)
    child = search.build_site_details(sites, (30.0, -100.0))
    docs = reports.build_detail_documents(trials.select("nct_id"), "nct_id", {"sites": (child, ["location_ordinal"], ["location_ordinal", "coordinate_source", "distance_miles"])})
    shown = F.transform("sites", lambda s: F.concat_ws(":", s["location_ordinal"].cast("string"), s["coordinate_source"], F.round(s["distance_miles"] * 10).cast("long").cast("string")))
    return docs.select(F.col("nct_id").alias("k"), F.array_join(shown, ";").alias("sites"))


@query("""WITH k AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations), p AS (SELECT unnest(CASE WHEN n % 3 = 0 THEN ['turn', 'said', 'said.by', 'said.parts', 'said.parts[].n'] ELSE ['turn', 'said', 'said.by', 'said.parts'] END) AS path FROM k) SELECT path, count(*) AS n FROM p GROUP BY 1""")
def udf3_variant_field_paths(t: Tables) -> DataFrame:
    n = F.length("text")
    parts = F.when(n % 3 == 0, F.array(F.struct(n.alias("n")), F.struct(n.alias("n")))).otherwise(F.array().cast("array<struct<n:int>>"))
    text = F.to_json(F.struct("turn", F.struct(F.col("role").alias("by"), parts.alias("parts")).alias("said")))
    return variants.field_paths(t.conversations.select("conv_id", "turn", text.alias("doc")), ["conv_id", "turn"], "doc").groupBy("path").agg(F.count("*").alias("n"))


@query("SELECT 'k' AS path, 'added' AS change UNION ALL SELECT 'a', 'removed'")
def qc4_variant_schema_drift(t: Tables) -> DataFrame:
    observed = variants.field_paths(t.events, ["event_id"], "props")
    return quality.drift(observed, t.spark.createDataFrame([("a",)], "path string"), "path")
