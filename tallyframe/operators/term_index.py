"""An index of names by their grams: a search reads the rows of one gram, not all names.

Every distinct name is posted once under each of its words' grams of one to three characters; who bears it stands in a table by name. A phrase that matches a
name in any way that ``terms`` scores has all grams of its words in that name, so the names of its rarest gram hold all answers; their bearers are
verified and scored by ``terms``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .terms import match_score

LONGEST = 3


def _grams(text: Column) -> Column:
    # a character is taken and its gram looked at ahead: lambdas over words would be interpreted, at twice the time
    of = lambda n: F.regexp_extract_all(F.lower(text), F.lit(rf"(?=({r'\S' * n}))\S"), F.lit(1))
    return F.array_distinct(F.concat(*(of(n) for n in range(1, LONGEST + 1))))


def phrase_grams(phrase: str) -> list[str]:
    """The longest grams of each word of a phrase."""
    out = {w[i : i + LONGEST] for w in phrase.lower().split() for i in range(max(1, len(w) - LONGEST + 1))}
    return sorted(out)


def build_term_index(names: DataFrame, root: str, files: int | None = None) -> None:
    """Write the postings (gram, name), the names' rows (name, concept, main) and the grams' counts under ``root``; ``names`` are concept, name, main.

    Both tables are dealt by ranges and sorted, so a gram's names stand together (a frequent gram's in several files), as do a name's rows, and Parquet's
    statistics leave other row groups unread. NULL names are posted nowhere.
    """
    rows, parts = names.where("name IS NOT NULL").select("name", "concept", "main"), [files] if files else []
    rows.repartitionByRange(*parts, "name", "concept").sortWithinPartitions("name", "concept").write.parquet(f"{root}/names")
    distinct = names.sparkSession.read.parquet(f"{root}/names").select("name").distinct()
    posted = distinct.select(F.explode(_grams(F.col("name"))).alias("gram"), "name")
    posted.repartitionByRange(*parts, "gram", "name").sortWithinPartitions("gram", "name").write.parquet(f"{root}/postings")
    counts = names.sparkSession.read.parquet(f"{root}/postings").groupBy("gram").agg(F.count("*").alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{root}/grams")


def postings(spark: SparkSession, root: str, phrase: str, stats: dict | None = None) -> DataFrame:
    """concept, name and main of the names under the phrase's rarest gram; no rows if one of its grams has none.

    ``stats`` gets ``gram`` and ``rows``, the names under it. The driver sees one row for each gram of the phrase, and the first and the last name of the rarest.
    """
    wanted = phrase_grams(phrase)
    if not wanted:
        raise ValueError("a phrase must have a character that isn't blank")
    known = {r["gram"]: r["n"] for r in spark.read.parquet(f"{root}/grams").where(F.col("gram").isin(wanted)).collect()}
    gram = min(wanted, key=lambda g: (known.get(g, 0), g))
    if stats is not None:
        stats |= {"gram": gram, "rows": known.get(gram, 0)}
    found = spark.read.parquet(f"{root}/postings").where(F.col("gram") == gram).select("name")
    low, high = found.agg(F.min("name"), F.max("name")).first()
    rows = spark.read.parquet(f"{root}/names").where(F.col("name").between(low, high) if low is not None else F.lit(False))
    return rows.join(found, "name").select("concept", "name", "main")


def search_index(spark: SparkSession, root: str, phrase: str, limit: int, stats: dict | None = None) -> DataFrame:
    """As ``terms.search_terms`` over all names: a concept's term is the first of its main names that match."""
    found = postings(spark, root, phrase, stats).withColumn("score", match_score(F.col("name"), phrase, F.col("main"))).where("score > 0")
    best = found.groupBy("concept").agg(F.max("score").alias("score"), F.min(F.when(F.col("main"), F.col("name"))).alias("term"))
    return best.orderBy(F.col("score").desc(), F.length("term"), "term", "concept").limit(limit)


def containing(spark: SparkSession, root: str, needle: str, stats: dict | None = None) -> DataFrame:
    """The names that contain a text literally, upper and lower case the same; a needle of several words must stand there as it is."""
    return postings(spark, root, needle, stats).where(F.contains(F.lower("name"), F.lit(needle.lower())))
