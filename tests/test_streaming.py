"""Streams over files agree with the batch results."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe.queries import windowed
from tallyframe.registry import Tables
from tallyframe.sources.pages import screen
from tallyframe.streaming import changes, states


def test_change_stream_equals_batch(spark, sf_dir, tmp_path):
    t = Tables(spark, sf_dir)
    daily = windowed.daily(t).withColumn("day", F.col("day").cast("timestamp")).persist()
    for k in range(3):  # files arrive in order of their days
        daily.where(F.floor(F.dayofmonth("day") / 11) == k).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    schema = daily.schema
    for k in range(3):
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/part{k}")
        root = f"{tmp_path}/out"
        # each part is a batch of its own query; the state is handed on
        if k:
            handed = changes.state_before(spark, f"{root}{k - 1}", 1, ["user_id"], "day", spark.read.parquet(f"{root}{k - 1}/state/batch=0").schema)
            handed.write.parquet(f"{root}{k}/state/whole=-1")
        changes.change_stream(stream, f"{root}{k}", ["user_id"], "day", "event_type", f"{tmp_path}/cp{k}").awaitTermination()
    got = {(r["user_id"], str(r["day"])[:10], r["previous"], r["event_type"]) for k in range(3) for r in spark.read.parquet(f"{tmp_path}/out{k}/changes").collect()}
    want = {(r["user_id"], str(r["day"])[:10], r["previous_status"], r["event_type"]) for r in windowed.history(t).where("changed").collect()}
    assert got == want and want


def test_state_is_kept_in_parts_and_made_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "COMPACT", 2)
    for k in range(5):
        rows = [(1, 10 * k + 1, "ab"[k % 2])] + [(100 + k, 10 * k, "x")] * 2 + [(100 + k, 10 * k, "y")]
        spark.createDataFrame(rows, "k long, at long, s string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k long, at long, s string").parquet(f"{tmp_path}/in")
        changes.change_stream(stream, f"{tmp_path}/out", ["k"], "at", "s", f"{tmp_path}/cp").awaitTermination()
    got = {(r["k"], r["at"], r["previous"], r["s"]) for r in spark.read.parquet(f"{tmp_path}/out/changes").collect()}
    assert got == {(1, 10 * k + 1, "ab"[(k - 1) % 2], "ab"[k % 2]) for k in range(1, 5)}
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    state = {(r["k"], r["at"], r["s"]) for r in changes.state_before(spark, f"{tmp_path}/out", 5, ["k"], "at", schema).collect()}
    assert state == {(1, 41, "a")} | {(100 + k, 10 * k, "y") for k in range(5)}
    assert spark.read.parquet(f"{tmp_path}/out/state/batch=4").count() == 2 and spark.read.parquet(f"{tmp_path}/out/state/whole=3").count() == 5


def test_a_lost_state_is_an_error(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, "a")], "k long, at long, s string")
    assert changes.state_before(spark, str(tmp_path), 0, ["k"], "at", rows.schema).collect() == []
    rows.write.parquet(f"{tmp_path}/state/batch=1")
    with pytest.raises(FileNotFoundError, match="batch=0 is gone"):
        changes.state_before(spark, str(tmp_path), 2, ["k"], "at", rows.schema)


def test_late_rows_change_nothing(spark):
    state = spark.createDataFrame([(1, 5, "a")], "k long, at long, s string")
    batch = spark.createDataFrame([(1, 4, "b"), (1, 6, "b"), (1, 6, "b"), (2, 1, "a"), (1, 7, None)], "k long, at long, s string")
    out = {(r["k"], r["at"]): (r["late"], r["changed"], r["previous"]) for r in changes.batch_changes(batch, state, ["k"], "at", "s").collect()}
    assert out == {(1, 4): (True, False, None), (1, 6): (False, True, "a"), (2, 1): (False, False, None), (1, 7): (False, True, "b")}


def test_ingest_splits_quarantine(spark, tmp_path):
    rows = spark.createDataFrame([("NCT00000001",), ("x",), (None,)], "id string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id string").parquet(f"{tmp_path}/in")
    changes.ingest_stream(stream, str(tmp_path), F.lit(True), F.col("id"), r"^NCT\d{8}$", f"{tmp_path}/cp").awaitTermination()
    bad = {r["reason"] for r in spark.read.parquet(f"{tmp_path}/quarantine").collect()}
    assert bad == {r["reason"] for r in screen(rows, F.lit(True), F.col("id"), r"^NCT\d{8}$").where("reason is not null").collect()} == {"MISSING_ID", "INVALID_ID_FORMAT"}
    assert spark.read.parquet(f"{tmp_path}/good").count() == 1


def test_windowed_counts(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "event_type")
    events.write.parquet(f"{tmp_path}/in")
    counts = changes.windowed_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "ts", "event_type", "1 day", "1 day")
    counts.writeStream.format("memory").queryName("per_day").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {(r["window"]["start"], r["event_type"]): r["n"] for r in spark.table("per_day").collect()}
    want = {(r["d"], r["event_type"]): r["n"] for r in events.groupBy(F.date_trunc("day", "ts").alias("d"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want and want


def test_keyed_state_gives_the_events_of_the_batch_form(spark, tmp_path):
    r = random.Random(7)
    rows = sorted({(r.randrange(5), 1000 + 3 * r.randrange(400), r.choice("abc")) for _ in range(260)}, key=lambda x: x[1])
    # batches out of order by up to 100 seconds, with ties in time and repeated rows
    order = sorted(rows, key=lambda x: x[1] + r.uniform(0, 100))
    parts = [order[i : i + 60] + order[i : i + 3] for i in range(0, len(order), 60)]
    schema = "k long, at timestamp, s string"
    for n, part in enumerate([*parts, [(99, 100_000, "z")]]):
        frame = spark.createDataFrame(part, "k long, at long, s string").withColumn("at", F.timestamp_seconds("at"))
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if n % 2 == 1 or n == len(parts):  # each run is a restart
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            states.write_change_events(stream, f"{tmp_path}/out", ["k"], "at", "s", "300 seconds", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").where("kind <> 'late'").selectExpr("k", "unix_seconds(at) at", "s", "previous", "kind = 'changed' changed", "kind").collect()
    empty = spark.createDataFrame([], schema)
    every = spark.createDataFrame(rows, "k long, at long, s string").withColumn("at", F.timestamp_seconds("at"))
    want = changes.batch_changes(every, empty, ["k"], "at", "s").selectExpr("k", "unix_seconds(at) at", "s", "previous", "changed").collect()
    assert Counter(tuple(x)[:5] for x in got if x["k"] != 99) == Counter(map(tuple, want)) and any(x["changed"] for x in want)
    assert {x["kind"] for x in got} == {"first", "same", "changed"}


def test_keyed_state_ends_and_late_rows_are_apart(spark, tmp_path):
    batches = [[(1, 100, "a"), (1, 105, None), (2, 103, "x")], [(1, 102, "c"), (2, 150, "x"), (3, None, "x")], [(1, 101, "z"), (2, 151, "y"), (3, 1000, "q")], [(4, 2000, "q")]]
    for part in batches:
        spark.createDataFrame(part, "k long, at long, s string").withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k long, at timestamp, s string").parquet(f"{tmp_path}/in")
        states.write_change_events(stream, f"{tmp_path}/out", ["k"], "at", "s", "10 seconds", f"{tmp_path}/cp", 50_000).awaitTermination()
    got = {tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").selectExpr("k", "unix_seconds(at)", "s", "previous", "kind").collect()}
    assert got == {
        (1, 100, "a", None, "first"), (1, 102, "c", "a", "changed"), (1, 105, None, "c", "changed"), (1, 101, "z", None, "late"), (1, 155, None, None, "silent"),
        (2, 103, "x", None, "first"), (2, 150, "x", "x", "same"), (2, 151, "y", "x", "changed"), (2, 201, None, "y", "silent"),
        (3, 1000, "q", None, "first"), (3, 1050, None, "q", "silent"),
    }
