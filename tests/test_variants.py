"""Paths by variants equal those by Python."""

from __future__ import annotations

import json
import random

import pytest

from tallyframe.functions.jsons import paths_of
from tallyframe.functions.variants import field_paths


def document(r, depth):
    kind = r.random()
    if depth and kind < 0.5:
        return {r.choice(["a", "b", "c d", "é", "x.y", "z[]", "A"]): document(r, depth - 1) for _ in range(r.randrange(4))}
    if depth and kind < 0.75:
        return [document(r, depth - 1) for _ in range(r.randrange(30 if r.random() < 0.1 else 3))]
    return r.choice([None, True, 1, 2.5, "t", "", 10**12])


def test_paths_of_random_documents(spark):
    r = random.Random(9)
    made = [document(r, 6) for _ in range(400)] + [{}, [], 3, {"a": {}}, {"a": []}, {"a": [{}, {"b": 1}]}, [[{"a": {"b": {"c": {"d": 1}}}}]], {"l": [0] * 25 + [{"late": 1}]}]
    rows = [(i, json.dumps(d, ensure_ascii=bool(i % 2))) for i, d in enumerate(made)] + [(-1, None), (-2, "no json"), (-3, "")]
    got = field_paths(spark.createDataFrame(rows, "id int, text string").withColumnRenamed("text", "pos"), ["id"], "pos", layers=6)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "ArrowEval" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(x) for x in got.collect()} == {(i, p) for i, d in enumerate(made) for p in paths_of(d)}
    assert got.count() == len({(i, p) for i, d in enumerate(made) for p in paths_of(d)})


def test_too_many_lists_stop_the_job(spark):
    rows = spark.createDataFrame([(1, '{"a": [[[{"b": 1}]]]}')], "id int, text string")
    assert {x["path"] for x in field_paths(rows, ["id"], "text", layers=4).collect()} == {"a", "a[][][].b"}
    with pytest.raises(Exception, match="more than 0 lists above a"):
        field_paths(rows, ["id"], "text", layers=0).collect()
