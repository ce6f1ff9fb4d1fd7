"""Scalar functions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, dates, jsons, numbers, text
from ..registry import Tables, query


@query("""
WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[''’]', '', 'g'), '[A-Z]', lower('\\0'), 'g'), 'x^', '', 'g')) AS x, text FROM documents)
SELECT doc_id, nullif(trim(regexp_replace(lower(regexp_replace(text, '[''’]', '', 'g')), '[^a-z0-9]+', ' ', 'g'), ' '), '') AS norm FROM t
""")
def fn_str1_normalize_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


@query(r"""SELECT doc_id, nullif(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), '') AS norm FROM documents""")
def fn_str2_normalize_unicode(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.normalize_text_unicode(F.col("text")).alias("norm"))


@query("SELECT o_orderkey, md5(concat_ws('||', coalesce(o_orderkey::VARCHAR,'__null__'), coalesce(o_orderstatus,'__null__'), coalesce(nullif(o_orderpriority,'5-LOW'),'__null__'))) AS row_key FROM orders")
def fn_str3_surrogate_key(t: Tables) -> DataFrame:
    low = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", text.surrogate_key(F.col("o_orderkey"), F.col("o_orderstatus"), low).alias("row_key"))


@query(r"SELECT s_suppkey, regexp_replace(s_name || CASE s_suppkey % 3 WHEN 0 THEN ' city' WHEN 1 THEN ' Town' ELSE '' END, '(?i) (metropolitan government|consolidated government|unified government|municipality|city|town|village|borough|CDP)$', '') AS place FROM supplier")
def fn_str4_strip_suffix(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 3
    name = F.concat("s_name", F.when(k == 0, " city").when(k == 1, " Town").otherwise(""))
    return t.supplier.select("s_suppkey", text.strip_suffix(name).alias("place"))


@query(r"SELECT p_partkey, trim(regexp_replace(trim(regexp_replace(upper('Race:  ' || p_name), '\s+', ' ', 'g')), '^(RACE:|ETHNICITY:)\s*', '')) AS label FROM part")
def fn_str5_clean_label(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.clean_label(F.concat(F.lit("Race:  "), F.col("p_name"))).alias("label"))


CLASSES = ((r"(?i)\blicense\b", "license"), (r"(?i)\breserved\b", "rights"), (r"@", "contact"), (r"(?i)\bthe\b", "english"))


@query(r"""SELECT CASE WHEN regexp_matches(text, '(?i)\blicense\b') THEN 'license' WHEN regexp_matches(text, '(?i)\breserved\b') THEN 'rights'
WHEN regexp_matches(text, '@') THEN 'contact' WHEN regexp_matches(text, '(?i)\bthe\b') THEN 'english' ELSE 'other' END AS class, count(*) AS n FROM documents GROUP BY 1""")
def fn_str6_classify_text(t: Tables) -> DataFrame:
    return t.documents.groupBy(text.classify_first(F.col("text"), CLASSES, "other").alias("class")).agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey, concat_ws('; ', CASE WHEN n > 20 THEN 'many customers (' || n || ')' END, CASE WHEN bal > 0 THEN 'mean balance ' || floor(bal)::BIGINT END, CASE WHEN n_regionkey = 1 THEN 'region one' END) AS why
FROM (SELECT n_nationkey, n_regionkey, count(c_custkey) AS n, coalesce(avg(c_acctbal), 0) AS bal FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)""")
def fn_str7_explanation(t: Tables) -> DataFrame:
    per = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_regionkey")
    per = per.agg(F.count("c_custkey").alias("n"), F.coalesce(F.avg("c_acctbal"), F.lit(0.0)).alias("bal"))
    return per.select("n_nationkey", text.explanation(
        (F.col("n") > 20, F.concat(F.lit("many customers ("), F.col("n"), F.lit(")"))),
        (F.col("bal") > 0, F.concat(F.lit("mean balance "), F.floor("bal"))),
        (F.col("n_regionkey") == 1, F.lit("region one")),
    ).alias("why"))


@query("SELECT page_id, split_part(url, '/', 3) AS host, left(url, 5) AS scheme, replace(url, 'http', 'HTTP') AS shown, strpos(url, '.') AS dot FROM pages")
def fn_str8_url_parts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.left("url", F.lit(5)).alias("scheme"), F.replace("url", F.lit("http"), F.lit("HTTP")).alias("shown"), F.instr("url", ".").cast("long").alias("dot"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS said FROM conversations")
def fn_str9_consumer_text(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.consumer_text(F.col("text")).alias("said"))


STATES = {"america": "AM", "asia": "AS", "europe": "EU"}


@query("""SELECT r_regionkey, coalesce(CASE lower(trim(r_name)) WHEN 'america' THEN 'AM' WHEN 'asia' THEN 'AS' WHEN 'europe' THEN 'EU' END, 'UNKNOWN') AS state,
CASE WHEN r_regionkey = 4 THEN 'facility' WHEN r_regionkey = 3 THEN 'city' WHEN lower(trim(r_name)) IN ('america','asia','europe') THEN 'state' ELSE 'country' END AS geo_scope, r_regionkey <> 2 AS us_location_flag FROM region""")
def fn_str10_11_state_and_scope(t: Tables) -> DataFrame:
    k, state = F.col("r_regionkey"), text.state_code(F.col("r_name"), STATES)
    country = F.when(k == 2, "Elsewhere").otherwise("United States")
    scope = text.geo_scope(F.when(k == 4, "hall"), F.when(k == 3, "town").otherwise(""), state, country)
    return t.region.select("r_regionkey", state.alias("state"), scope.alias("geo_scope"), text.in_country(country, ("united states", "usa")).alias("us_location_flag"))


def _partial(c: str = "o_orderdate"):
    k = F.col("o_orderkey") % 5
    return F.when(k == 0, F.date_format(c, "yyyy-MM-dd")).when(k == 1, F.date_format(c, "yyyy-MM")).when(k == 2, F.date_format(c, "yyyy")).when(k == 3, "soon")


_PARTIAL = "CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate,'%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate,'%Y-%m') WHEN 2 THEN strftime(o_orderdate,'%Y') WHEN 3 THEN 'soon' END"


@query(f"""SELECT o_orderkey, coalesce(try_strptime(d,'%Y-%m-%d'), try_strptime(d,'%Y-%m'), try_strptime(d,'%Y'))::DATE AS day,
CASE WHEN d IS NULL THEN 'missing' WHEN d = 'soon' THEN 'unparseable' WHEN length(d) = 10 THEN 'day' WHEN length(d) = 7 THEN 'month' ELSE 'year' END AS precision FROM (SELECT o_orderkey, {_PARTIAL} AS d FROM orders)""")
def fn_date1_2_partial_dates(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", dates.parse_partial_date(_partial()).alias("day"), dates.date_precision(_partial()).alias("precision"))


@query("""SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS days, date_diff('month', o_orderdate::DATE, l_shipdate::DATE) AS months, (year(o_orderdate) // 5 * 5)::INTEGER AS five_years
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def fn_date3_5_spans(t: Tables) -> DataFrame:
    both = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("l_orderkey", "l_linenumber", F.datediff("l_shipdate", "o_orderdate").cast("long").alias("days"), dates.month_diff(F.col("l_shipdate"), F.col("o_orderdate")).cast("long").alias("months"), dates.five_year_bucket(F.col("o_orderdate")).alias("five_years"))


@query("""SELECT strftime(o_orderdate,'%Y-%m') AS year_month, quarter(o_orderdate) AS quarter, dayname(o_orderdate) AS day_name, date_trunc('quarter', o_orderdate)::DATE AS quarter_start, isodow(o_orderdate) >= 6 AS is_weekend, count(*) AS n FROM orders GROUP BY ALL""")
def fn_date4_calendar_parts(t: Tables) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return t.orders.groupBy(F.date_format(d, "yyyy-MM").alias("year_month"), F.quarter(d).cast("long").alias("quarter"), F.date_format(d, "EEEE").alias("day_name"), F.trunc(d, "quarter").alias("quarter_start"), (F.weekday(d) >= 5).alias("is_weekend")).agg(F.count("*").alias("n"))


@query("SELECT event_id, (ts::VARCHAR)::TIMESTAMP::DATE AS day, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3.6e9, 6) AS age_hours FROM events")
def fn_date6_8_utc_and_age(t: Tables) -> DataFrame:
    shown = F.col("ts").cast("string")
    return t.events.select("event_id", dates.utc_timestamp(shown).cast("date").alias("day"), F.round(dates.hours_between(F.lit("2024-02-01").cast("timestamp"), F.col("ts")), 6).alias("age_hours"))


@query("""WITH b AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS z FROM orders),
s AS (SELECT unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE AS day FROM b), n AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1)
SELECT day, coalesce(n, 0) AS n_orders FROM s LEFT JOIN n USING (day)""")
def fn_date7_calendar_spine(t: Tables) -> DataFrame:
    ends = t.orders.agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("z"))
    spine = ends.select(F.explode(F.sequence("a", "z")).alias("day"))
    counts = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("""SELECT l_suppkey, n, r, round(r::DOUBLE / nullif(n, 0), 8) AS share,
round(greatest(0, ((r::DOUBLE/n) + 1.96*1.96/(2*n) - 1.96*sqrt(((r::DOUBLE/n)*(1-(r::DOUBLE/n)) + 1.96*1.96/(4*n))/n)) / (1 + 1.96*1.96/n)), 8) AS low,
round(least(1, ((r::DOUBLE/n) + 1.96*1.96/(2*n) + 1.96*sqrt(((r::DOUBLE/n)*(1-(r::DOUBLE/n)) + 1.96*1.96/(4*n))/n)) / (1 + 1.96*1.96/n)), 8) AS high
FROM (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)""")
def fn_num1_2_wilson_share(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    low, high = numbers.wilson(F.col("r"), F.col("n"))
    return per.select("l_suppkey", "n", "r", F.round(numbers.safe_divide(F.col("r"), F.col("n")), 8).alias("share"), F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


@query("""WITH p AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey <> 7 THEN 25.0 + n_nationkey END AS lat, -120.0 + 2*n_nationkey AS lon FROM nation)
SELECT a.k AS a, b.k AS b, round(CASE WHEN a.lat IS NOT NULL AND b.lat IS NOT NULL THEN 2*3958.8*asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(b.lat-a.lat)/2),2) + cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2))))) END, 6) AS miles
FROM p a JOIN p b ON a.k < b.k""")
def fn_num3_haversine(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    p = t.nation.select(k.alias("k"), F.when(k != 7, 25.0 + k).alias("lat"), (-120.0 + 2 * k).alias("lon"))
    a, b = (p.select(*(F.col(c).alias(f"{c}_{s}") for c in p.columns)) for s in "ab")
    return a.join(b, F.col("k_a") < F.col("k_b")).select(F.col("k_a").alias("a"), F.col("k_b").alias("b"), F.round(numbers.haversine_miles(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")), 6).alias("miles"))


@query("""SELECT p_partkey, low, high, CASE WHEN low IS NULL AND high IS NULL THEN 'unbounded' WHEN high IS NULL THEN 'minimum_only' WHEN low IS NULL THEN 'maximum_only' WHEN low > high THEN 'contradictory' ELSE 'range' END AS bounds,
(low IS NULL OR low <= 2) AND (high IS NULL OR high >= 2) AS fits_two
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN round(p_size / 12.0, 6) WHEN 2 THEN p_size::DOUBLE END AS low, CASE WHEN p_partkey % 3 = 0 THEN round(p_size * 7 / 365.25, 6) END AS high FROM part)""")
def fn_num4_5_ages(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    stated = F.when(k % 4 == 1, F.concat(size, F.lit(" Months"))).when(k % 4 == 2, F.concat(size, F.lit(" Year"))).when(k % 4 == 3, "N/A")
    ages = t.part.select("p_partkey", F.round(numbers.parse_age_years(stated), 6).alias("low"), F.round(numbers.parse_age_years(F.when(k % 3 == 0, F.concat(size, F.lit(" weeks")))), 6).alias("high"))
    return ages.select("*", numbers.age_bounds(F.col("low"), F.col("high")).alias("bounds"), numbers.age_matches(F.col("low"), F.col("high"), 2).alias("fits_two"))


@query("""SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 40 THEN 'medium' ELSE 'large' END AS band, least(4, floor(l_discount / 0.25) + 1)::INTEGER AS quartile, count(*) AS n FROM lineitem GROUP BY ALL""")
def fn_num6_9_bands(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(numbers.banded(F.col("l_quantity"), ((10, "small"), (40, "medium")), "large").alias("band"), numbers.quartile_of_unit(F.col("l_discount")).alias("quartile")).agg(F.count("*").alias("n"))


@query("""SELECT c_nationkey, count(*) AS orders, round(count(*)::DOUBLE / count(DISTINCT c_custkey) * 100000, 4) AS per_100k FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def fn_num7_rates(t: Tables) -> DataFrame:
    per = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("orders"), F.countDistinct("c_custkey").alias("base"))
    return per.select("c_nationkey", "orders", numbers.rate_per(F.col("orders"), F.col("base"), 100_000).alias("per_100k"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 AND user_id % 2 = 0 THEN try_cast(json_extract_string(props, '$.k') AS BIGINT) END AS n FROM events""")
def fn_num8_head_count(t: Tables) -> DataFrame:
    unit, kind = F.when(F.col("event_id") % 2 == 0, "Participants").otherwise("Units"), F.when(F.col("user_id") % 2 == 0, "COUNT_OF_PARTICIPANTS").otherwise("MEAN")
    return t.events.select("event_id", numbers.head_count(F.get_json_object("props", "$.k"), unit, kind).alias("n"))


@query("""WITH b AS (SELECT l_orderkey, list_sort(list_distinct(list(p_brand))) AS brands FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT l_orderkey, array_to_string(brands, '|') AS brands, list_has_any(brands, ['Brand#1', 'Brand#11', 'Brand#12']) AS overlap, len(brands)::INTEGER AS n FROM b""")
def fn_arr1_list_intersect(t: Tables) -> DataFrame:
    per = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("l_orderkey").agg(arrays.distinct_sorted("p_brand").alias("b"))
    wanted = F.array(*map(F.lit, ("Brand#1", "Brand#11", "Brand#12")), F.lit(None).cast("string"))
    return per.select("l_orderkey", F.array_join("b", "|").alias("brands"), arrays.overlaps(F.col("b"), wanted).alias("overlap"), F.size("b").alias("n"))


@query("""SELECT p_partkey, pos - 1 AS pos, word, list_contains(words, 'x') AS has_x FROM (SELECT p_partkey, string_split(p_name, ' ') AS words, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part)""")
def fn_arr2_split_with_order(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    return t.part.select("p_partkey", F.array_contains(words, "x").alias("has_x"), F.posexplode(words).alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none.deeper') AS absent FROM events")
def fn_json1_paths(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.none.deeper").alias("absent"))


@query("SELECT event_id, sha256(replace(props, ': ', ':')) AS doc_hash FROM events")
def udf2_canonical_json_hash(t: Tables) -> DataFrame:
    return t.events.select("event_id", jsons.canonical_hash("props").alias("doc_hash"))


@query("SELECT path, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS path FROM events) GROUP BY 1")
def udf3_json_field_paths(t: Tables) -> DataFrame:
    return t.events.select(F.explode(jsons.field_paths("props")).alias("path")).groupBy("path").agg(F.count("*").alias("n"))
