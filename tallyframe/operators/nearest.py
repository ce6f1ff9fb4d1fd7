"""Nearest places without a radius: cells that double in size only for points whose nearest aren't certain yet.

Places stand on a sphere in space, cut into cubes, so neither the poles nor the date line need rules of their own. A point meets the
places of its cube and the 26 around it; whatever lies elsewhere is at least a cube's side away as the crow flies through
the earth. If its k-th nearest is nearer than that, it is settled; the others go on with cubes of double side, up to one that holds the earth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import haversine_miles
from .stages import written

#: Miles.
RADIUS = 3958.8
#: Side of the first cubes in miles.
FIRST = 16.0
#: Cubes of this side aren't halved.
LEAST = 0.5


def _cube(axis: str, side: float) -> Column:
    return F.floor((F.col(axis) + RADIUS) / side)


def _crowd(targets: DataFrame, side: float) -> float:
    """How many places the cube of a place holds, itself included, on average over the places."""
    per = targets.groupBy(*(_cube(f"_{a}", side) for a in "xyz")).agg(F.count("*").cast("double").alias("n"))
    return per.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]


def _in_space(rows: DataFrame, lat: str, lon: str) -> DataFrame:
    flat = RADIUS * F.cos(F.radians(lat))
    return rows.withColumns({"_x": flat * F.cos(F.radians(lon)), "_y": flat * F.sin(F.radians(lon)), "_z": RADIUS * F.sin(F.radians(lat))})


def nearest_places(points: DataFrame, places: DataFrame, k: int = 1, first: float = FIRST) -> DataFrame:
    """The k nearest places of every point: point columns, ``rank`` (from 1), ``place``, ``miles`` and ``compared``, by distance, then place.

    points: ``point`` (its key), ``lat``, ``lon``; places: ``place``, ``place_lat``, ``place_lon``. Points or places without
    coordinates take no part; a point has fewer than k rows only where there are fewer places. ``compared`` is the number of distinct
    locations that the point's own location was compared with, over all sizes of cubes.

    Points of one location are one, and of one location's places only the first k can count, so a crowd at one spot costs no more than
    k rows. The first cubes have sides of ``first``, or of its half, quarter and so on if places share them with more than 2 k others on average, so more
    places don't make more pairs of a point. Cubes double, so there are about log2(earth / side) steps at most.
    """
    spark = points.sparkSession
    spots = _in_space(points.where("lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon").distinct(), "lat", "lon")
    same = Window.partitionBy("place_lat", "place_lon").orderBy("place")
    few = places.where("place_lat IS NOT NULL AND place_lon IS NOT NULL AND place IS NOT NULL").select("place", "place_lat", "place_lon").distinct()
    few = few.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k)
    targets = few.groupBy("place_lat", "place_lon").agg(F.sort_array(F.collect_list("place")).alias("_places"))  # at most k of each
    targets = written(_in_space(targets, "place_lat", "place_lon"), "places")
    rest = written(spots.withColumn("_seen", F.lit(0).cast("long")), "points")
    total, side, found = targets.count(), first, None
    while total and side > LEAST and _crowd(targets, side) > 2 * k:
        side /= 2
    while total:
        last = side > 2 * RADIUS  # one cube and those around it hold the earth
        held = targets.select("place_lat", "place_lon", "_places", *(_cube(f"_{a}", side).alias(f"_c{a}") for a in "xyz"))
        around = F.sequence(F.lit(-1), F.lit(1))  # points are laid out, as they become fewer
        laid = rest.select("lat", "lon", F.explode(around).alias("_dx"), *(_cube(f"_{a}", side).alias(f"_c{a}") for a in "xyz"))
        laid = laid.withColumn("_dy", F.explode(around)).withColumn("_dz", F.explode(around)).withColumns({f"_c{a}": F.col(f"_c{a}") + F.col(f"_d{a}") for a in "xyz"})
        miles = haversine_miles(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon"))
        near = laid.join(held, ["_cx", "_cy", "_cz"]).select("lat", "lon", "_places", miles.alias("miles"))
        every = Window.partitionBy("lat", "lon")
        ranked = near.withColumn("_r", F.row_number().over(every.orderBy("miles", F.col("_places")[0]))).where(F.col("_r") <= k)
        cubes = held.groupBy("_cx", "_cy", "_cz").agg(F.count("*").alias("_held"))  # counts need no pairs
        counts = laid.join(cubes, ["_cx", "_cy", "_cz"]).groupBy("lat", "lon").agg(F.sum("_held").alias("_new"))
        best = ranked.select("lat", "lon", "miles", F.explode("_places").alias("place")).withColumn("rank", F.row_number().over(every.orderBy("miles", "place"))).where(F.col("rank") <= k)
        best = best.groupBy("lat", "lon").agg(F.sort_array(F.collect_list(F.struct("rank", "place", "miles"))).alias("_best"))  # k rows each
        done = rest.join(best, ["lat", "lon"], "left").join(counts, ["lat", "lon"], "left").withColumn("_seen", F.col("_seen") + F.coalesce("_new", F.lit(0)))
        # the straight line to a place at this distance; a little is left for rounding
        chord = 2 * RADIUS * F.sin(F.element_at("_best", -1)["miles"] / (2 * RADIUS))
        certain = F.lit(True) if last else F.coalesce((F.size("_best") == k) & (chord < side * (1 - 1e-9)), F.lit(False))
        done = written(done.withColumn("_sure", certain), "nearest")
        settled = done.where("_sure").select("lat", "lon", "_seen", "_best")
        found = settled if found is None else found.unionByName(settled)
        rest = done.where("NOT _sure").select("lat", "lon", "_x", "_y", "_z", "_seen")
        if last or rest.isEmpty():
            break
        side *= 2
    if found is None:
        kind = places.schema["place"].dataType.simpleString()
        return spark.createDataFrame([], points.schema).withColumns({"rank": F.lit(0), "place": F.lit(None).cast(kind), "miles": F.lit(0.0), "compared": F.lit(0).cast("long")})
    out = points.join(found, ["lat", "lon"]).withColumn("_b", F.explode("_best"))
    return out.select(*points.columns, F.col("_b.rank").alias("rank"), F.col("_b.place").alias("place"), F.col("_b.miles").alias("miles"), F.col("_seen").alias("compared"))
