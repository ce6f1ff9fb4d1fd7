"""Ranked matching of phrases with terms and synonyms, and hierarchies from tree codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores of a main term and of a synonym by kind of match.
SCORES = {"exact": (100, 90), "prefix": (80, 70), "token": (65, 55), "contains": (50, 40), "all": (45, 35)}


def match_score(name: Column, phrase: str, main: Column) -> Column:
    q, low = phrase.lower().strip(), F.lower(name)
    tokens = F.split(low, r"\s+")
    every = F.size(F.array_except(F.array(*map(F.lit, q.split())), tokens)) == 0
    value = lambda kind: F.when(main, SCORES[kind][0]).otherwise(SCORES[kind][1])
    return (
        F.when(low == q, value("exact")).when(F.startswith(low, F.lit(q)), value("prefix")).when(F.exists(tokens, lambda t: F.startswith(t, F.lit(q))), value("token"))
        .when(F.contains(low, F.lit(q)), value("contains")).when(every, value("all")).otherwise(0)
    )


def search_terms(names: DataFrame, phrase: str, limit: int) -> DataFrame:
    """``names`` (concept, name, main): concepts by their best score, then shorter and earlier names."""
    scored = names.withColumn("score", match_score(F.col("name"), phrase, F.col("main"))).where("score > 0")
    best = scored.groupBy("concept").agg(F.max("score").alias("score"), F.min(F.when(F.col("main"), F.col("name"))).alias("term"))
    return best.orderBy(F.col("score").desc(), F.length("term"), "term", "concept").limit(limit)


def broader(codes: DataFrame) -> DataFrame:
    """For each (concept, code) the nearest code above it that exists."""
    above = codes.select("concept", "code", F.posexplode(F.split("code", r"\.")).alias("at", "_"), F.split("code", r"\.").alias("parts")).where("at > 0")
    above = above.select("concept", "code", "at", F.array_join(F.slice("parts", 1, F.col("at")), ".").alias("up"))
    found = above.join(codes.select(F.col("code").alias("up"), F.col("concept").alias("broader")), "up")
    nearest = found.withColumn("rn", F.row_number().over(Window.partitionBy("concept", "code").orderBy(F.col("at").desc(), "broader"))).where("rn = 1")
    return codes.join(nearest.select("concept", "code", "broader"), ["concept", "code"], "left")
