"""Window operators and incremental steps on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import incremental as I
from ..operators import windows as W
from ..registry import Tables, query

DAILY_SQL = """daily AS (SELECT user_id, day, event_type FROM (SELECT user_id, ts::DATE AS day, event_type, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)"""


def daily(t: Tables) -> DataFrame:
    """The last event of each user and day: what a snapshot observes."""
    rows = t.events.withColumn("day", F.col("ts").cast("date"))
    return W.latest_per_key(rows, ["user_id", "day"], F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "day", "event_type")


@query(f"WITH {DAILY_SQL} SELECT * FROM daily")
def win1_latest_per_key(t: Tables) -> DataFrame:
    return daily(t)


HISTORY_SQL = f"""{DAILY_SQL}, h AS (SELECT user_id, day, event_type, lag(event_type) OVER w AS previous_status, lag(day) OVER w AS previous_date, min(day) OVER (PARTITION BY user_id) AS first_seen FROM daily WINDOW w AS (PARTITION BY user_id ORDER BY day)),
history AS (SELECT user_id, day, event_type, previous_status, previous_date, previous_date IS NOT NULL AND event_type IS DISTINCT FROM previous_status AS changed,
coalesce(previous_date IS NOT NULL AND event_type = 'purchase' AND previous_status IS DISTINCT FROM 'purchase', false) AS entered,
coalesce(previous_date IS NOT NULL AND event_type IS DISTINCT FROM 'purchase' AND previous_status = 'purchase', false) AS "left", first_seen, date_diff('day', first_seen, day)::INTEGER AS days_since_first FROM h)"""


def history(t: Tables) -> DataFrame:
    return W.status_history(daily(t), ["user_id"], "day", "event_type", "purchase").withColumn("left", F.coalesce("left", F.lit(False))).withColumn("entered", F.coalesce("entered", F.lit(False)))


@query(f"WITH {HISTORY_SQL} SELECT * FROM history")
def mrt1_win2_3_status_history(t: Tables) -> DataFrame:
    return history(t)


@query("""WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, day, n, (sum(n) OVER w)::BIGINT AS week, first_value(n) OVER w AS start_n, min(day) OVER w AS earliest FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)""")
def win4_trailing_days(t: Tables) -> DataFrame:
    d = t.events.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    w = W.trailing(["event_type"], "day", 7)
    return d.select("event_type", "day", "n", F.sum("n").over(w).alias("week"), F.first("n").over(w).alias("start_n"), F.min("day").over(w).alias("earliest"))


@query("""WITH d AS (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT p, month, n, round(avg(n) OVER w, 6) AS quarter_avg, first_value(n) OVER w AS start_n, min(n) OVER (PARTITION BY p ORDER BY month) AS low_so_far, max(n) OVER (PARTITION BY p ORDER BY month) AS high_so_far FROM d
WINDOW w AS (PARTITION BY p ORDER BY month RANGE BETWEEN INTERVAL 3 MONTHS PRECEDING AND CURRENT ROW)""")
def win5_6_trailing_months(t: Tables) -> DataFrame:
    d = t.orders.groupBy(F.col("o_orderpriority").alias("p"), F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"))
    w, run = W.trailing_months(["p"], "month", 3), Window.partitionBy("p").orderBy("month")
    return d.select("p", "month", "n", F.round(F.avg("n").over(w), 6).alias("quarter_avg"), F.first("n").over(w).alias("start_n"), F.min("n").over(run).alias("low_so_far"), F.max("n").over(run).alias("high_so_far"))


@query("""SELECT *, CASE WHEN r < 0.5 THEN 'low' WHEN r < 0.8 THEN 'moderate' ELSE 'elevated' END AS band FROM (SELECT n_regionkey, n_nationkey, n, round(percent_rank() OVER (PARTITION BY n_regionkey ORDER BY n), 8) AS r FROM (SELECT n_regionkey, n_nationkey, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2))""")
def win7_percent_rank_bands(t: Tables) -> DataFrame:
    per = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.count("*").alias("n"))
    ranked = per.withColumn("r", F.round(F.percent_rank().over(Window.partitionBy("n_regionkey").orderBy("n")), 8))
    return ranked.withColumn("band", W.rank_band(F.col("r")))


@query("SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 25")
def win8_top_25(t: Tables) -> DataFrame:
    over = Window.partitionBy("l_suppkey").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")
    return t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", F.row_number().over(over).cast("long").alias("rank")).where("rank <= 25")


@query("""WITH d AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN props END AS mark FROM events)
SELECT user_id, event_id, last_value(mark IGNORE NULLS) OVER w AS filled, (sum(CASE WHEN mark IS NOT NULL THEN 1 ELSE 0 END) OVER w)::BIGINT AS grp FROM d WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def win9_forward_fill(t: Tables) -> DataFrame:
    d = t.events.select("user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("props")).alias("mark"))
    out = W.forward_fill(d, ["user_id"], ["event_id"], "mark", "filled")
    over = Window.partitionBy("user_id").orderBy("event_id")
    return out.select("user_id", "event_id", "filled", F.sum(F.when(F.col("mark").isNotNull(), 1).otherwise(0)).over(over).alias("grp"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS has_r, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_returnflag) AS m FROM lineitem) WHERE (NOT has_r OR l_returnflag = 'R') AND l_linenumber = m")
def win10_window_filter(t: Tables) -> DataFrame:
    per = Window.partitionBy("l_orderkey")
    rows = t.lineitem.withColumn("has_r", F.bool_or(F.col("l_returnflag") == "R").over(per)).withColumn("m", F.min("l_linenumber").over(Window.partitionBy("l_orderkey", "l_returnflag")))
    return rows.where((~F.col("has_r") | (F.col("l_returnflag") == "R")) & (F.col("l_linenumber") == F.col("m"))).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, total FROM (SELECT o_orderkey, o_totalprice, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F') ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def win11_page_with_total(t: Tables) -> DataFrame:
    found = t.orders.where("o_orderstatus = 'F'")
    page = found.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20).select("o_orderkey")
    return page.crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))  # the total is one row


@query("""SELECT l_orderkey, l_linenumber, ntile(3) OVER w AS tercile, lead(l_shipdate::DATE) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS next_day, max(l_quantity) OVER (PARTITION BY l_suppkey) - l_quantity AS below_top FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_shipdate)""")
def win12_terciles_and_lead(t: Tables) -> DataFrame:
    w, line = Window.partitionBy("l_suppkey").orderBy("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"), Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.ntile(3).over(w).cast("long").alias("tercile"), F.lead(F.col("l_shipdate").cast("date")).over(line).alias("next_day"), (F.max("l_quantity").over(Window.partitionBy("l_suppkey")) - F.col("l_quantity")).alias("below_top"))


@query("SELECT day, lag(day) OVER (ORDER BY day) AS previous_day, n FROM (SELECT ts::DATE AS day, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1)")
def win13_run_lag(t: Tables) -> DataFrame:
    runs = t.events.where("event_type <> 'error'").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return runs.select("day", F.lag("day").over(Window.orderBy("day")).alias("previous_day"), "n")  # one row per run


@query("""WITH c AS (SELECT s_suppkey, basis, prio, v FROM (SELECT s_suppkey, 'exact' AS basis, 1 AS prio, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END AS v FROM supplier UNION ALL SELECT s_suppkey, 'zip', 2, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey::DOUBLE END FROM supplier UNION ALL SELECT s_suppkey, 'city', 3, 0.5 FROM supplier) WHERE v IS NOT NULL)
SELECT s_suppkey, basis, v FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY prio) AS rn FROM c) WHERE rn = 1""")
def win14_coordinate_basis(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    found = F.coalesce(F.when(k % 3 == 0, F.struct(F.lit("exact").alias("basis"), F.col("s_acctbal").alias("v"))), F.when(k % 2 == 0, F.struct(F.lit("zip").alias("basis"), F.col("s_nationkey").cast("double").alias("v"))), F.struct(F.lit("city").alias("basis"), F.lit(0.5).alias("v")))
    return t.supplier.select("s_suppkey", found.alias("f")).select("s_suppkey", "f.basis", "f.v")


@query("SELECT p_brand, max_by(p_name, p_partkey) AS label FROM part GROUP BY 1")
def win15_latest_label(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.max_by("p_name", "p_partkey").alias("label"))


_WEEKS = """a AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE ts < TIMESTAMP '2024-01-08' GROUP BY 1), b AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-09' GROUP BY 1)"""


@query(f"WITH {_WEEKS} SELECT user_id, event_id, 'week2' AS run_id, false AS carried FROM b UNION ALL SELECT user_id, event_id, 'week2', true FROM a WHERE user_id NOT IN (SELECT user_id FROM b)")
def flt18_carry_forward(t: Tables) -> DataFrame:
    ts = F.col("ts")
    old = t.events.where(ts < F.lit("2024-01-08").cast("timestamp_ntz")).groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    new = t.events.where((ts >= F.lit("2024-01-08").cast("timestamp_ntz")) & (ts < F.lit("2024-01-09").cast("timestamp_ntz"))).groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return I.carry_forward(old, new, "user_id", {"run_id": F.lit("week2")})


@query("""WITH d AS (SELECT DISTINCT ts::DATE AS day, day(ts) % 7 = 1 AS full_run FROM events), last_full AS (SELECT max(day) AS f FROM d WHERE full_run), done AS (SELECT day FROM d WHERE day(day) % 3 = 0)
SELECT day, full_run FROM d, last_full WHERE day >= f AND day NOT IN (SELECT day FROM done)""")
def flt20_pending_runs(t: Tables) -> DataFrame:
    day = F.col("ts").cast("date")
    runs = t.events.select(day.alias("day"), (F.dayofmonth(day) % 7 == 1).alias("full_run")).distinct()
    return I.pending_runs(runs, runs.where(F.dayofmonth("day") % 3 == 0), "day", "full_run")


@query("SELECT max(ts) - INTERVAL 1 DAY AS bound FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def flt21_lower_bound(t: Tables) -> DataFrame:
    made = t.events.where("event_type = 'signup'").select("user_id")
    return I.lower_bound(t.events.where("event_type = 'purchase'").join(made, "user_id", "left_semi"), "ts")


@query(f"""WITH {HISTORY_SQL} SELECT md5(user_id || '||' || day || '||' || 'status') AS change_id, user_id, day, previous_status AS old_value, event_type AS new_value FROM history WHERE changed AND day >= DATE '2024-01-16'""")
def snk4_append_new_events(t: Tables) -> DataFrame:
    changes = history(t).where("changed").select(F.md5(F.concat_ws("||", "user_id", "day", F.lit("status"))).alias("change_id"), "user_id", "day", F.col("previous_status").alias("old_value"), F.col("event_type").alias("new_value"))
    return I.not_yet_written(changes, changes.where("day < DATE '2024-01-16'"), "change_id")
