"""Running sums, bitmaps, intervals and the term index against plain results."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.operators import bitmaps, intervals, running, term_index, terms

DAY = dt.date(2025, 1, 1)


def day(n):
    return DAY + dt.timedelta(n)


def test_running_over_all_equals_one_window(spark):
    r = random.Random(2)
    rows = spark.createDataFrame([(i, r.choice([None, r.randrange(20)]), r.choice([None, r.randrange(-5, 9)]), r.choice("xyz")) for i in range(3000)], "id int, a int, v int, t string").repartition(7)
    got = running.running_over_all(rows, ["a", "id"], {"upto": F.col("v"), "twice": 2 * F.col("v")}, "number", {"before": "t"})
    over = Window.orderBy("a", "id")
    want = rows.select("*", F.coalesce(F.sum("v").over(over), F.lit(0)).alias("upto"), F.coalesce(F.sum(2 * F.col("v")).over(over), F.lit(0)).alias("twice"), F.row_number().over(over).cast("long").alias("number"), F.lag("t").over(over).alias("before"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString() and "SinglePartition" in want._jdf.queryExecution().executedPlan().toString()
    assert running.running_over_all(rows.where("false"), ["a"], {"upto": F.col("v")}, "n").collect() == []


def test_bitmaps_of_any_union_count_distinct_keys(spark):
    r = random.Random(3)
    data = [(r.choice(["p", "q", None]), r.choice("AB"), r.randrange(30), r.choice([None, *[f"k{r.randrange(90_000):05}"] * 5])) for _ in range(70_000)]
    rows = spark.createDataFrame(data, "profile string, phase string, day int, key string").repartition(5)
    bits, numbers = bitmaps.build_key_bitmaps(rows, ["profile", "phase", "day"], "key")
    bits = bits.cache()
    n = numbers.agg(F.count("*"), F.min("number"), F.max("number"), F.countDistinct("number")).first()
    assert n[0] == n[3] == n[2] + 1 and n[1] == 0 and n[0] > 33_000
    for by in (["profile", "phase", "day"], ["profile", "day"], ["phase"], []):
        want = rows.groupBy(*by).agg(F.countDistinct("key").alias("n"))
        assert sorted(map(str, bitmaps.distinct_in(bits, by).collect())) == sorted(map(str, want.collect()))
    flags = {"early": F.col("day") < 10, "a_or_p": (F.col("phase") == "A") | (F.col("profile") == "p"), "none": F.lit(False)}
    want = rows.groupBy("phase").agg(*(F.countDistinct(F.when(c, F.col("key"))).alias(n) for n, c in flags.items()))
    assert sorted(map(str, bitmaps.distinct_in(bits, ["phase"], flags).collect())) == sorted(map(str, want.collect()))
    # scopes that share segments
    scopes = spark.createDataFrame([("one", "p"), ("two", "p"), ("two", "q")], "scope string, profile string")
    want = rows.join(scopes, "profile").groupBy("scope").agg(F.countDistinct("key").alias("n"))
    assert sorted(map(tuple, bitmaps.distinct_in(bits.join(scopes, "profile"), ["scope"]).collect())) == sorted(map(tuple, want.collect()))
    halves = [bits.where("day < 15"), bits.where("day >= 15")]
    assert bitmaps.distinct_in(bitmaps.add_keys(*halves, ["profile", "phase", "day"]), []).collect() == bitmaps.distinct_in(bits, []).collect()
    assert bitmaps.build_key_bitmaps(rows.where("false"), ["phase"], "key")[0].collect() == []


def history_of(seed):
    """Snapshots of eight keys: mostly unchanged, sometimes gone and back, with unknown states."""
    r, state, rows = random.Random(seed), {}, []
    for d in sorted(r.sample(range(200), 25)):
        for k in range(8):
            if r.random() < 0.2:
                state[k] = r.choice([("a", 1), ("b", None), ("a", 2), (None, None), None])
            if state.get(k):
                rows.append((k, day(d), *state[k]))
    return rows


def test_intervals_hold_what_the_days_hold(spark):
    schema = "k int, d date, s string, n int"
    rows = history_of(4)
    history = spark.createDataFrame(rows, schema).repartition(3)
    days = sorted({x[1] for x in rows})
    made = intervals.build_intervals(history, ["k"], "d", ["s", "n"]).cache()
    step = None
    for d in days:
        snapshot = history.where(F.col("d") == F.lit(d))
        step = snapshot.select("k", "s", "n", F.lit(d).alias("valid_from"), F.lit(None).cast("date").alias("valid_to")) if step is None else intervals.with_snapshot(step, snapshot, F.lit(d), ["k"], ["s", "n"])
        step = spark.createDataFrame(step.collect(), made.schema)
        assert sorted(map(str, intervals.as_of(made, F.lit(d)).select("k", "s", "n").collect())) == sorted(map(str, snapshot.select("k", "s", "n").collect()))
    assert sorted(map(str, step.collect())) == sorted(map(str, made.collect()))
    assert made.count() < 0.6 * len(rows)
    # one more snapshot without a change adds nothing
    same = intervals.with_snapshot(made, history.where(F.col("d") == F.lit(days[-1])), F.lit(day(300)), ["k"], ["s", "n"])
    assert sorted(map(str, same.collect())) == sorted(map(str, made.collect()))
    points = spark.createDataFrame([(k, day(n)) for k in range(9) for n in range(0, 260, 7)], "k int, at date")
    got = {(x["k"], x["at"]): (x["s"], x["n"]) for x in intervals.at_their_days(points, made, ["k"], "at", F.lit(day(260))).collect()}
    held = {(x[0], x[1]): x[2:] for x in rows}
    want = {}
    for k, at in points.collect():
        seen = max((d for d in days if d <= at), default=None)
        if (k, seen) in held:
            want[k, at] = held[k, seen]
    assert got == want


WORDS = "alpha fever of the lung syndrome type ii a-b disease cardiac acute in".split()


def test_the_index_gives_what_a_scan_gives(spark, tmp_path):
    r = random.Random(6)
    rows = [(f"C{i % 150}", " ".join(r.sample(WORDS, r.randrange(1, 5))).title() + r.choice(["", " 2", "  x"]), i < 150) for i in range(600)] + [("C1", None, True), ("C2", "", False)]
    names = spark.createDataFrame(rows, "concept string, name string, main boolean").repartition(3)
    term_index.build_term_index(names, f"{tmp_path}/index", 4)
    for phrase in ["fever", "FEVER of", "l", "lung fever", "ac", "type ii", "a-b dis", "ease", "zzz", "the lung syndrome", "in acute", "fever fever", " Alpha "]:
        stats = {}
        got = term_index.search_index(spark, f"{tmp_path}/index", phrase, 40, stats).collect()
        assert got == terms.search_terms(names, phrase, 40).collect(), phrase
        assert stats["rows"] < len(rows) or len(phrase) < 3
        inside = term_index.containing(spark, f"{tmp_path}/index", phrase).collect()
        assert sorted(map(str, inside)) == sorted(map(str, names.where(F.contains(F.lower("name"), F.lit(phrase.lower()))).collect())), phrase
    plan = term_index.postings(spark, f"{tmp_path}/index", "fever")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(gram), EqualTo(gram," in plan
    with pytest.raises(ValueError, match="blank"):
        term_index.postings(spark, f"{tmp_path}/index", "  ")


def test_the_index_posts_a_name_once(spark, tmp_path):
    names = spark.range(3000).select(F.col("id").alias("concept"), F.concat(F.lit("name "), F.col("id") % 5).alias("name"), (F.col("id") % 2 == 0).alias("main"))
    root = f"{tmp_path}/index"
    term_index.build_term_index(names, root)
    assert spark.read.parquet(f"{root}/postings").count() == 5 * (4 + 3 + 2 + 1)  # the grams of "name" and of the number, for five names, not 3,000 rows
    assert term_index.containing(spark, root, "me 3").count() == 600 and term_index.containing(spark, root, "me 7").count() == 0
    stats = {}
    best = term_index.search_index(spark, root, "name 4", 10, stats).collect()
    assert stats["rows"] == 1 and [x["concept"] for x in best] == list(range(4, 100, 10)) and {(x["score"], x["term"]) for x in best} == {(100, "name 4")}


def test_grams_are_cut_by_compiled_code(spark):
    r = random.Random(10)
    texts = ["".join(r.choice("abXY#-\u00e9\U0001f600\U0001d4b3\u00a0 \t\n\x0b\x85") for _ in range(r.randrange(12))) for _ in range(500)] + ["", " ", "\U0001f600", "a\U0001f600b c", "ECONOMY Brand#16"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", term_index._grams(F.col("t")).alias("grams"))
    for t, grams in got.collect():
        words = re.split(r"[ \t\n\x0b\f\r]+", t.lower())
        assert sorted(grams) == sorted({w[i : i + n] for w in words for n in (1, 2, 3) for i in range(len(w) - n + 1)}), t
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()
