"""Connected components of a graph given by its edges, by alternating large and small stars on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, join_keyed


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has longs u and v. Returns node and label (the least node it reaches) for each node that has an edge.

    Every step is an aggregate per node and a join back to its edges. A node with very many edges is never gathered in one
    place: the aggregate is combined before the shuffle, and the join deals such a node to several tasks. It ends when a
    round changes nothing, after about log2 of the longest path.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = join_keyed(both, _least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        large = cut(large, "edges")
        small = join_keyed(large, _least(large), "u")
        edges = cut(
            small.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v"))).distinct(),
            "edges",
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
