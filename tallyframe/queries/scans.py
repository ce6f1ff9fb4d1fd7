"""Sources, flattening and staging on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, sections, text
from ..operators.windows import latest_per_key
from ..registry import Tables, query
from ..sources import pages, reference, sinks


@query("SELECT doc_id, pos - 1 AS raw_ordinal, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)")
def src1_records_with_ordinal(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("raw_ordinal", "line")).withColumn("raw_ordinal", F.col("raw_ordinal").cast("long"))


@query(r"""SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 50 = 0 THEN 'NOT_AN_OBJECT' WHEN id IS NULL OR trim(id) = '' THEN 'MISSING_ID' WHEN NOT regexp_matches(id, '^Customer#0*[1-9][0-9]{0,2}$') THEN 'INVALID_ID_FORMAT' END AS reason
FROM (SELECT c_custkey, nullif(c_name, (SELECT min(c_name) FROM customer)) AS id FROM customer)) GROUP BY 1""")
def src2_screening(t: Tables) -> DataFrame:
    least = t.customer.agg(F.min("c_name").alias("least"))
    rows = t.customer.crossJoin(F.broadcast(least)).withColumn("id", F.nullif("c_name", F.col("least")))  # one row
    out = pages.screen(rows, F.col("c_custkey") % 50 != 0, F.col("id"), "^Customer#0*[1-9][0-9]{0,2}$")
    return out.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, NULL::VARCHAR AS mapping_source, 'none' AS mapping_label FROM lineitem")
def src4_5_tolerant_scan(t: Tables) -> DataFrame:
    rows = reference.read_or_empty(t.spark, f"{t.sf_dir}/lineitem.parquet", "l_orderkey long, l_linenumber int, l_quantity double, mapping_source string")
    absent = reference.read_or_empty(t.spark, f"{t.sf_dir}/no_such_entity.parquet", "l_orderkey long, l_linenumber int, l_quantity double, mapping_source string")
    return reference.with_defaults(rows.unionByName(absent), {"mapping_label": F.coalesce("mapping_source", F.lit("none"))})


@query("SELECT DISTINCT c_custkey AS run_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def src6_runs_without_companion(t: Tables) -> DataFrame:
    return reference.runs_without(t.customer.select(F.col("c_custkey").alias("run_id")), t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("run_id")), "run_id")


@query("""WITH m AS (SELECT l_orderkey, 'price' AS label, l_extendedprice AS e, l_tax AS g FROM lineitem UNION ALL SELECT l_orderkey, 'quantity', l_quantity, CASE WHEN l_discount - 0.05 >= 0 THEN l_discount - 0.05 END FROM lineitem)
SELECT l_orderkey, label, round(sum(e), 4) AS population, round(sqrt(sum(g*g)), 8) AS margin_of_error FROM m GROUP BY 1, 2""")
def src10_melt_and_sum(t: Tables) -> DataFrame:
    wide = t.lineitem.withColumn("m", F.col("l_discount") - 0.05)
    long = reference.melted(wide, ["l_orderkey"], {"price": ("l_extendedprice", "l_tax"), "quantity": ("l_quantity", "m")})
    return reference.summed(long, ["l_orderkey", "label"]).select("l_orderkey", "label", F.round("population", 4).alias("population"), F.round("margin_of_error", 8).alias("margin_of_error"))


@query("SELECT p_brand AS state_code, 'M' || p_partkey AS measure_id, p_retailprice AS prevalence_pct, p_size::BIGINT AS adult_population FROM part WHERE p_size % 2 = 1")
def src11_crude_prevalence(t: Tables) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    kind = F.when(F.col("p_size") % 2 == 1, "CrdPrv").otherwise("AgeAdjPrv")
    rows = t.part.select(kind.alias("datavaluetypeid"), F.col("p_brand").alias("stateabbr"), s("p_partkey").alias("locationid"), F.col("p_name").alias("locationname"), F.concat(F.lit("M"), "p_partkey").alias("measureid"), F.col("p_type").alias("measure"), s("p_retailprice").alias("data_value"), s("p_retailprice").alias("low_confidence_limit"), s("p_retailprice").alias("high_confidence_limit"), s("p_size").alias("totalpop18plus"), F.lit("2024").alias("year"))
    return reference.crude_prevalence(rows).select("state_code", "measure_id", "prevalence_pct", "adult_population")


@query(r"""SELECT doc_id, regexp_extract(line, '([A-Z]{2,}) ([A-Z]{2,})', 1) AS program, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '^[A-Z][a-z]+ .*\.$') GROUP BY 1, 2""")
def src12_line_extraction(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"^[A-Z][a-z]+ .*\.$"))
    return lines.groupBy("doc_id", F.regexp_extract("line", "([A-Z]{2,}) ([A-Z]{2,})", 1).alias("program")).agg(F.count("*").alias("n"))


@query("SELECT p_brand, sum(p_size)::BIGINT AS n FROM part GROUP BY 1")
def src13_exclusive_sum(t: Tables) -> DataFrame:
    return reference.shares(t.part, "p_brand", "p_size").withColumnRenamed("p_size", "n")


@query("""WITH w AS (SELECT s_nationkey, p_type, sum(l_quantity) AS w FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY w DESC, p_type) AS rn, w / sum(w) OVER (PARTITION BY s_nationkey) AS share FROM w)
SELECT s_nationkey, p_type, w, round(share, 8) AS share FROM r WHERE rn = 1""")
def src14_dominant_group(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return reference.dominant_group(joined, "s_nationkey", "p_type", "l_quantity").withColumn("share", F.round("share", 8))


@query("""SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"status":' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}' AS doc FROM orders""")
def snk5_json_with_nulls(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", sinks.audit_json("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status")).alias("doc"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.a.b') AS ab, value >= 50 AS has_high FROM events")
def flt1_nested_paths(t: Tables) -> DataFrame:
    parsed = F.from_json("props", "k long, a struct<b: string>")
    return t.events.select("event_id", parsed["k"].alias("k"), parsed["a"]["b"].alias("ab"), (F.col("value") >= 50).alias("has_high"))


@query("""SELECT word, grp, count(*) AS n FROM (SELECT word, CASE WHEN word = 'part' THEN 'noun' WHEN contains(word, '1') THEN 'numbered' ELSE 'unmapped' END AS grp FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part)) GROUP BY 1, 2""")
def flt2_4_explode_and_map(t: Tables) -> DataFrame:
    words = t.part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return words.groupBy("word", text.classify_first(F.col("word"), (("^part$", "noun"), ("1", "numbered")), "unmapped").alias("grp")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT user_id, floor(value)::INTEGER % 5 || '' AS mesh_id, event_type AS term, event_type <> 'purchase' AS is_ancestor, event_id FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, mesh_id ORDER BY is_ancestor, event_id) AS rn FROM d) SELECT user_id, mesh_id, term AS mesh_term, is_ancestor FROM r WHERE rn = 1""")
def flt3_direct_before_ancestor(t: Tables) -> DataFrame:
    d = t.events.select("user_id", (F.floor("value").cast("int") % 5).cast("string").alias("mesh_id"), F.col("event_type").alias("mesh_term"), (F.col("event_type") != "purchase").alias("is_ancestor"), "event_id")
    return latest_per_key(d, ["user_id", "mesh_id"], F.col("is_ancestor"), F.col("event_id")).drop("event_id")


@query("SELECT o_orderkey, pos - 1 AS ordinal, word FROM (SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS word, generate_subscripts(string_split(o_orderpriority, '-'), 1) AS pos FROM orders)")
def flt5_7_8_ordinals(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.transform(F.split("o_orderpriority", "-"), lambda w: F.struct(w.alias("word"))).alias("arms"))
    return pages.entity(rows, ["o_orderkey"], "arms", {"word": "word"}, "ordinal")


@query("SELECT l_orderkey, 'lead_sponsor' AS role, s_name AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber = 1 UNION ALL SELECT l_orderkey, 'collaborator', s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber > 1")
def flt6_lead_and_collaborators(t: Tables) -> DataFrame:
    named = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).where(F.col("s_name").isNotNull())
    return named.select("l_orderkey", F.when(F.col("l_linenumber") == 1, "lead_sponsor").otherwise("collaborator").alias("role"), F.col("s_name").alias("name"))


@query("""WITH s AS (SELECT conv_id, turn, unnest(string_split(text, '. ')) AS sent, generate_subscripts(string_split(text, '. '), 1) - 1 AS c FROM conversations),
w AS (SELECT conv_id, turn, c, unnest(string_split(sent, ' ')) AS word, generate_subscripts(string_split(sent, ' '), 1) - 1 AS g FROM s) SELECT * FROM w""")
def flt9_nested_explode(t: Tables) -> DataFrame:
    s = t.conversations.select("conv_id", "turn", F.posexplode(F.split("text", r"\. ")).alias("c", "sent"))
    return s.select("conv_id", "turn", F.col("c").cast("long").alias("c"), F.posexplode(F.split("sent", " ")).alias("g", "word")).withColumn("g", F.col("g").cast("long"))


@query("""SELECT flag, count(*) AS n FROM (SELECT coalesce(nullif(concat_ws(',', CASE WHEN l_discount > 0.08 THEN 'HIGH_DISCOUNT' END, CASE WHEN l_shipdate < o_orderdate THEN 'SHIPPED_BEFORE_ORDER' END, CASE WHEN l_quantity < 2 THEN 'LOW_QUANTITY' END), ''), 'ok') AS flag FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1""")
def flt10_quality_flag(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    flag = text.nested_flag((F.col("l_discount") > 0.08, "HIGH_DISCOUNT"), (F.col("l_shipdate") < F.col("o_orderdate"), "SHIPPED_BEFORE_ORDER"), (F.col("l_quantity") < 2, "LOW_QUANTITY"))
    return joined.groupBy(flag.alias("flag")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT o_custkey, list_sort(list_distinct(list(CASE WHEN o_orderpriority = '5-LOW' THEN 'NA' ELSE o_orderpriority END))) AS v FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(v, '|') AS phase_raw, array_to_string(list_transform(v, lambda x: CASE WHEN x = 'NA' THEN 'NOT_APPLICABLE' ELSE x END), '/') AS phase_normalized, list_contains(v, 'NA') AS has_na FROM p""")
def flt11_12_phases(t: Tables) -> DataFrame:
    phase = F.when(F.col("o_orderpriority") == "5-LOW", "NA").otherwise(F.col("o_orderpriority"))
    per = t.orders.groupBy("o_custkey").agg(arrays.distinct_sorted(phase).alias("v"))
    raw, named = arrays.joined_phases(F.col("v"))
    return per.select("o_custkey", raw.alias("phase_raw"), named.alias("phase_normalized"), F.exists("v", lambda x: x == "NA").alias("has_na"))


@query("SELECT c_custkey, sha256(concat_ws('|', c_custkey::VARCHAR, c_name, c_mktsegment)) AS source_hash, NULL::VARCHAR AS taxonomy FROM customer")
def flt13_14_source_hash(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.sha2(F.concat_ws("|", "c_custkey", "c_name", "c_mktsegment"), 256).alias("source_hash"), F.lit(None).cast("string").alias("taxonomy"))


@query("""WITH k AS (SELECT nullif(url, '') AS k, md5(html) AS h FROM pages), p AS (SELECT k, count(*) AS n, count(DISTINCT h) AS h FROM k GROUP BY 1)
SELECT sum(n)::BIGINT AS n_records, coalesce(sum(n) FILTER (WHERE k IS NULL), 0)::BIGINT AS n_missing, coalesce(sum(n - 1) FILTER (WHERE k IS NOT NULL), 0)::BIGINT AS n_duplicates, count(*) FILTER (WHERE k IS NOT NULL AND h > 1) AS n_conflicts FROM p""")
def flt15_dedup_stats(t: Tables) -> DataFrame:
    keyed = t.pages.select(F.nullif(F.col("url"), F.lit("")).alias("k"), F.md5("html").alias("h"))
    return pages.dedup_stats(keyed, "k", "h")


@query("SELECT a.user_id, a.day FROM (SELECT user_id, ts::DATE AS day, hour(ts) AS hr, max(value) AS v FROM events GROUP BY 1, 2, 3) a JOIN (SELECT user_id, ts::DATE AS day, hour(ts) AS hr, min(value) AS v FROM events GROUP BY 1, 2, 3) b USING (user_id, day, hr) WHERE a.v IS DISTINCT FROM b.v")
def flt16_conflicting_runs(t: Tables) -> DataFrame:
    per = t.events.groupBy("user_id", F.col("ts").cast("date").alias("day"), F.hour("ts").alias("hr")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return per.where(~F.col("low").eqNullSafe(F.col("high"))).select("user_id", "day")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O','F') AND o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE lower(p_type) IN (SELECT lower(p_type) FROM part WHERE p_partkey <= 2))")
def flt17_preset_selection(t: Tables) -> DataFrame:
    terms = t.part.where("p_partkey <= 2").select(F.lower("p_type").alias("term")).distinct()
    members = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).join(terms, F.lower("p_type") == F.col("term"), "left_semi")
    return t.orders.where(F.col("o_orderstatus").isin("O", "F")).join(members, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@query(r"""SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '<contact>', 'g') AS clean FROM documents""")
def flt22_contact_removal(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.regexp_replace("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<contact>").alias("clean"))


@query("""SELECT o_orderkey, o_orderdate::DATE AS day, floor(o_totalprice)::BIGINT AS enrolled, nullif(trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')), '') AS priority FROM (SELECT *, NULL FROM orders WHERE o_orderkey IS NOT NULL)""")
def stg1_typed_projection(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderkey").isNotNull()).select("o_orderkey", F.col("o_orderdate").cast("string").try_cast("date").alias("day"), F.floor("o_totalprice").alias("enrolled"), text.normalize_text(F.col("o_orderpriority")).alias("priority"))


@query("""WITH m(label, cat, low_confidence) AS (VALUES ('SMALL','s',false), ('LARGE','l',true)), d AS (SELECT p_partkey, p_size, CASE WHEN p_size <= 15 THEN 'SMALL' WHEN p_size >= 40 THEN 'LARGE' ELSE 'MEDIUM' END AS label FROM part)
SELECT d.label, m.cat, m.cat IS NULL AS unmapped, coalesce(m.low_confidence, false) AS ambiguous, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM part), 8) AS share FROM d LEFT JOIN m USING (label) GROUP BY 1, 2, 3, 4""")
def stg6_classified_map_join(t: Tables) -> DataFrame:
    mapping = t.spark.createDataFrame([("SMALL", "s", False), ("LARGE", "l", True)], "label string, cat string, low boolean")
    d = t.part.withColumn("label", F.when(F.col("p_size") <= 15, "SMALL").when(F.col("p_size") >= 40, "LARGE").otherwise("MEDIUM"))
    joined = d.join(F.broadcast(mapping), "label", "left")  # two hand-written rows
    per = joined.groupBy("label", "cat", F.col("cat").isNull().alias("unmapped"), F.coalesce("low", F.lit(False)).alias("ambiguous")).agg(F.count("*").alias("n"))
    total = t.part.agg(F.count("*").alias("total"))  # one row
    return per.crossJoin(F.broadcast(total)).select("label", "cat", "unmapped", "ambiguous", "n", F.round(F.col("n") / F.col("total"), 8).alias("share"))


@query("SELECT event_id::VARCHAR AS nct_id, json_extract_string(props, '$.contactName') AS contact_name FROM events WHERE json_extract_string(props, '$.contactName') IS NOT NULL")
def stg7_empty_contacts(t: Tables) -> DataFrame:
    """Contacts left in the records after their removal: the relation is there, and empty as long as the removal holds."""
    return t.events.select(F.col("event_id").cast("string").alias("nct_id"), F.get_json_object("props", "$.contactName").alias("contact_name")).where("contact_name IS NOT NULL")


_MARKED = r"CASE WHEN page_id % 3 = 0 THEN 'Inclusion Criteria:' || chr(10) || '- ' || url || chr(10) || 'Exclusion Criteria' || chr(10) || '1. ' || html ELSE html END"


@query(rf"""WITH l AS (SELECT page_id, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS pos FROM (SELECT page_id, {_MARKED} AS x FROM pages)),
k AS (SELECT *, CASE WHEN trim(line) = 'Exclusion Criteria' THEN 'exclusion' WHEN trim(line) = 'Inclusion Criteria:' THEN 'inclusion' END AS opens FROM l),
f AS (SELECT *, coalesce(last_value(opens IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unclassified') AS kind FROM k)
SELECT kind, count(*) AS lines, count(opens) AS headings, count(*) FILTER (WHERE regexp_matches(line, '^\s*(?:[-*•·]|\d{{1,2}}[.)]|[a-z][.)])\s+')) AS bullets FROM f GROUP BY 1""")
def udf1_section_lines(t: Tables) -> DataFrame:
    marked = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Inclusion Criteria:\n- "), "url", F.lit("\nExclusion Criteria\n1. "), "html")).otherwise(F.col("html"))
    lines = sections.section_lines(t.pages.select("page_id", marked.alias("x")), "page_id", "x")
    return lines.groupBy("kind").agg(F.count("*").alias("lines"), F.count_if("is_heading").alias("headings"), F.count_if("is_bullet").alias("bullets"))


@query("SELECT conv_id, turn, true AS lossless FROM conversations")
def udf4_lossless_sections(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", (sections.rebuilt(sections.split_sections(F.col("text"))) == F.col("text")).alias("lossless"))
