"""Operators on edges that the driver's tables don't have, and properties against plain versions."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.functions.numbers import haversine_miles
from tallyframe.operators import quality, relational as R
from tallyframe.operators import windows as W
from tallyframe.operators.paging import keyset_page
from tallyframe.plans import history as H

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def miles(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    x = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 3958.8 * math.asin(math.sqrt(min(1, x)))


@FEW
@given(seed=st.integers(0, 10_000), radius=st.sampled_from([10.0, 75.0, 300.0]))
def test_grid_join_finds_every_pair(spark, seed, radius):
    r = random.Random(seed)
    a = [(i, r.uniform(-85, 85), r.uniform(-175, 175)) for i in range(40)]
    b = [(i, x + r.uniform(-2, 2), y + r.uniform(-2, 2)) for i, x, y in a]
    got = R.within_miles(spark.createDataFrame(a, "a long, a_lat double, a_lon double"), spark.createDataFrame(b, "b long, b_lat double, b_lon double"), radius, haversine_miles(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
    assert {(x["a"], x["b"]) for x in got.collect()} == {(i, j) for i, p, q in a for j, s, t in b if miles(p, q, s, t) <= radius}


@FEW
@given(seed=st.integers(0, 10_000), days=st.sampled_from([1, 7, 30]))
def test_nearest_within_is_exact(spark, seed, days):
    r = random.Random(seed)
    a, b = [[(r.randrange(3), day(r.randrange(120)), i) for i in range(25)] for _ in range(2)]
    left, right = spark.createDataFrame(a, "k long, d1 date, x long"), spark.createDataFrame(b, "k long, d2 date, y long")
    got = {row["x"]: (row["gap"], row["d2"]) for row in R.nearest_within(left, right, "k", "d1", "d2", days).collect()}
    for k, d, x in a:
        near = [(abs((e - d).days), e) for j, e, _ in b if j == k and abs((e - d).days) <= days]
        assert got[x] == (min(near) if near else (None, None))


def test_keyset_pages_cover_everything_once(spark):
    rows = [(i, [None, 1.0, 2.0, 2.0][i % 4]) for i in range(23)]
    df, after, seen = spark.createDataFrame(rows, "k long, v double"), None, []
    while True:
        page = keyset_page(df, "v", "k", after, size=5).collect()
        seen += [r["k"] for r in page[:5]]
        if len(page) <= 5:
            break
        after = (page[4]["v"], page[4]["k"])
    assert seen == [k for k, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]


def test_unknown_is_not_zero(spark):
    """Windows that aren't covered give NULL, covered ones without entries 0; a gap in the calendar uncovers."""
    days = [*range(0, 12), 20, 21]
    seen = [("s", f"k{k}", day(d)) for d in days for k in range(3)]
    rows = spark.createDataFrame([(s, k, d, k == "k0" and d == day(11), d - dt.timedelta(days=1)) for s, k, d in seen], "scope string, k string, day date, entered boolean, before date").withColumn("g", F.lit("g"))
    out = {r["day"]: r for r in H.competition(rows, rows, ["scope"], ["g"], "k", "day", "entered", "before", (5,), 5, tolerance=1).collect()}
    assert out[day(4)]["new_5d"] is None and out[day(5)]["new_5d"] == 0 and out[day(11)]["new_5d"] == 1
    assert out[day(5)]["growth_5d"] == 0.0 and out[day(20)]["new_5d"] is None and out[day(21)]["new_5d"] is None


def test_concentration_and_null_owner(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", None), ("b", "x"), ("b", "y"), ("b", "z"), (None, "x")], "g string, o string")
    out = {r["g"]: r for r in R.concentration(rows, ["g"], "o", F.count("*")).collect()}
    assert out["a"]["owners"] == 2 and out["a"]["hhi"] is None and abs(out["a"]["top_share"] - 1 / 3) < 1e-9
    assert abs(out["b"]["hhi"] - 1 / 3) < 1e-9 and out[None]["owners"] == 1


def test_status_history_edges(spark):
    rows = spark.createDataFrame([(1, day(0), None), (1, day(2), "a"), (1, day(3), "a"), (1, day(5), None), (2, day(1), "a")], "k long, day date, s string")
    got = {(r["k"], r["day"]): (r["changed"], r["entered"], r["left"]) for r in W.status_history(rows, ["k"], "day", "s", "a").collect()}
    assert got[1, day(2)][:2] == (True, True) and got[1, day(3)][0] is False and got[1, day(5)] == (True, False, True)
    assert got[2, day(1)] == (False, False, False)


def test_change_events_compare_pairs_of_columns(spark):
    obs = spark.createDataFrame([(1, 1, "x", None, "E"), (1, 2, "x", 5, "E"), (2, 1, "x", 5, "E"), (2, 2, "y", 5, "A")], "k long, run long, s string, n long, t string")
    runs = spark.createDataFrame([(1, None), (2, 1)], "run long, previous_run long")
    got = {(r["k"], r["field"], r["old_value"], r["new_value"]) for r in H.change_events(obs, ["k"], "run", runs, {"status": ["s"], "enrolment": ["n", "t"]}).collect()}
    assert got == {(1, "enrolment", "E", "5|E"), (2, "status", "x", "y"), (2, "enrolment", "5|E", "5|A")}


def test_rules_tiers_and_masks(spark):
    rules = spark.createDataFrame([("exact", "abc", 9, "e"), ("substring", "b", 1, "s")], "kind string, term string, ord int, label string")
    rows = spark.createDataFrame([(1, "abc"), (2, "xb"), (3, "q"), (4, None)], "id long, t string")
    assert {r["id"]: (r["label"], r["tier"]) for r in R.tiered_rules(rows, "t", rules, "id").collect()} == {1: ("e", 0), 2: ("s", 1), 3: (None, None), 4: (None, None)}


@pytest.mark.parametrize("values,weights,want", [([1, 2, None], [1, 1, 1], 2.0), ([1, None], [1, 3], None), ([5], [0], 5.0)])
def test_weighted_median(spark, values, weights, want):
    df = spark.createDataFrame([("g", v, w) for v, w in zip(values, weights, strict=True)], "g string, v long, w long")
    assert R.weighted_median(df, ["g"], "v", "w").first()["median"] == want


def test_pairs_leave_out_common_tokens(spark):
    df = spark.createDataFrame([(i, "hot") for i in range(10)] + [(1, "t"), (2, "t"), (3, None), (4, None)], "k long, tok string")
    pairs = R.pairs_by_token(df, "k", "tok", 5)
    assert {tuple(r) for r in pairs.collect()} == {(1, 2)} and {tuple(r) for r in R.mirrored(pairs).collect()} == {(1, 2), (2, 1)}


def test_guard_checks_name_rows_given_without_cover(spark):
    days = spark.createDataFrame([("s", day(n)) for n in (0, 5, 10)], "scope string, day date")
    entries = spark.createDataFrame([("s", "g", day(5), day(0)), ("s", "h", day(10), day(-3))], "scope string, grp string, day date, before date")
    rows = spark.createDataFrame([("s", g, day(n), v) for g, n, v in (("g", 5, 1), ("g", 10, 1), ("h", 10, 1), ("g", 0, 1), ("h", 0, None))], "scope string, grp string, day date, n int")
    check = lambda n: sorted(r["item"] for r in quality.uncovered_windows("x", rows, "n", days, entries, ["scope"], ["grp"], "day", "before", n, 2).collect())
    # at 10 the entry of h comes from before the window; at day 0 there is no history
    assert check(10) == sorted([f"s|g|{day(0)}", f"s|g|{day(5)}", f"s|h|{day(10)}"])
    # the window of day 10 holds the entry of g at day 5, whose snapshot before is out of it
    assert check(5) == sorted([f"s|g|{day(0)}", f"s|g|{day(10)}", f"s|h|{day(10)}"])


def test_growth_without_its_base_month_is_named(spark):
    from datetime import date

    months = [date(2025, m, 1) for m in (1, 2, 4, 5, 6)]
    rows = spark.createDataFrame([("s", "g", m, 1.0) for m in months], "scope string, grp string, month date, growth double")
    seen = spark.createDataFrame([("s", m) for m in months], "scope string, day date")
    named = {r["item"][-10:] for r in quality.ungrounded_growth("x", rows, "growth", seen, ["scope"], ["grp"], "day").collect()}
    # only April (January, 90 days) and May (February) have a base; June would need March
    assert named == {"2025-01-01", "2025-02-01", "2025-06-01"}
