"""Nearest places against brute force."""

from __future__ import annotations

import math
import random

import pytest

from tallyframe.operators.nearest import nearest_places


def miles(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 3958.8 * math.asin(math.sqrt(min(1.0, max(0.0, x))))


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_places_against_brute_force(spark, k):
    r = random.Random(k)
    city = lambda: (40 + r.gauss(0, 0.3), -75 + r.gauss(0, 0.3))
    anywhere = lambda: (math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180))
    points = [city() for _ in range(60)] + [anywhere() for _ in range(30)] + [(90.0, 0.0), (-90.0, 10.0), (0.0, 180.0), (0.0, -180.0), (89.9, 120.0), (40.0, -75.0), (40.0, -75.0)]
    places = [city() for _ in range(300)] + [anywhere() for _ in range(15)] + [(89.95, -60.0), (0.1, 179.9), (-0.1, -179.8)] + [(40.01, -75.0)] * 40
    rows = spark.createDataFrame([(i, *p, "x") for i, p in enumerate(points)] + [(500, None, 1.0, "x"), (501, 1.0, None, "x")], "point int, lat double, lon double, _best string")
    sites = spark.createDataFrame([(i, *p) for i, p in enumerate(places)] + [(900, None, 1.0), (None, 40.0, -75.0)], "place int, place_lat double, place_lon double").repartition(3)
    got = nearest_places(rows.drop("_best"), sites, k).collect()
    by_point = {}
    for x in got:
        by_point.setdefault(x["point"], []).append((x["rank"], x["place"], round(x["miles"], 6)))
    for i, p in enumerate(points):
        want = sorted((miles(p, q), j) for j, q in enumerate(places))[:k]
        assert [(n, round(d, 4)) for n, _, d in sorted(by_point[i])] == [(n + 1, round(d, 4)) for n, (d, _) in enumerate(want)], i
        assert [j for _, j, _ in sorted(by_point[i])] == [j for _, j in want]
    assert by_point.keys() == set(range(len(points)))
    compared = {x["point"]: x["compared"] for x in got}
    assert sum(compared[i] for i in range(60)) < 0.6 * 60 * len(set(places))


def test_fewer_places_than_asked_for(spark):
    points = spark.createDataFrame([(1, 10.0, 20.0), (1, 10.0, 20.0)], "point int, lat double, lon double")
    places = spark.createDataFrame([("a", -10.0, -160.0), ("b", -10.0, -160.0)], "place string, place_lat double, place_lon double")
    assert sorted((r["rank"], r["place"]) for r in nearest_places(points, places, 5).collect()) == [(1, "a"), (1, "a"), (2, "b"), (2, "b")]
    none = nearest_places(points, places.where("false"), 5)
    assert none.columns == ["point", "lat", "lon", "rank", "place", "miles", "compared"] and none.collect() == []
    assert nearest_places(points.where("false"), places).collect() == []


def test_many_places_make_no_more_pairs(spark):
    r = random.Random(9)
    places = [(i, r.uniform(-60, 60), r.uniform(-180, 180)) for i in range(3000)]
    points = spark.createDataFrame([(i, r.uniform(-60, 60), r.uniform(-180, 180)) for i in range(60)], "point int, lat double, lon double")
    got = nearest_places(points, spark.createDataFrame(places, "place int, place_lat double, place_lon double"), 2, 4096.0).collect()
    assert len(got) == 120 and sum(x["compared"] for x in got) < 120 * 150  # with cubes of 4,096 miles all 3,000 are compared
    for x in got:
        assert round(x["miles"], 6) == round(sorted(miles((x["lat"], x["lon"]), p[1:]) for p in places)[x["rank"] - 1], 6)
