"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

The sources, by code point with null last, weigh 5, 2, 1, 5, ... and share PERCENT percent of all sizes; a source's
target stops at MOST times its size, and what it can't take is shared again by weight, until no target is too high.
That ends at one price per unit of weight, found by a running sum over the sources in the order in which they fill up.

A source is taken whole as often as it fits into its target; the rest is a budget for part of its documents: those of
lowest hash, up to a threshold. LEVELS histograms find it: sizes are summed by source and hash bucket, a running sum
finds the bucket in which the budget ends, and the next level splits that bucket alone by the next bits of the hash.
The last bucket is taken if that comes nearer to the budget. Documents are then filtered by comparing hashes: no sort.

Defined results: a null or blank text has size 0; a null source is a source; rows whose doc_id and text are both the same
(null or not) share a hash and are taken or left together; an empty table gives no rows; other columns are kept by ``mix``, whatever their
names, and ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD_SQL, cut, fresh_name

WEIGHTS = (5, 2, 1)
PERCENT = 150
MOST = 2
#: Levels of the histogram, each by so many hexadecimal digits of the hash.
LEVELS, DIGITS = 4, 3
#: Up to so many sources their thresholds are broadcast (about 100 bytes each); beyond, they are joined by source.
FEW_SOURCES = 50_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_SQL)), F.lit(0)).cast("long")


def hashed() -> Column:
    """As many digits as the levels need, from doc_id and the text's own hash."""
    return F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))), 1, LEVELS * DIGITS)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size (long) to target (double). One row per source; the windows below see these rows only."""
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("most", MOST * F.col("source_size"))
    # sources in the order in which a rising price fills them
    filling = Window.orderBy(F.col("most") / F.col("weight"), "place")
    every = Window.partitionBy()
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("filled", F.coalesce(F.sum("most").over(before), F.lit(0)))
    ranked = ranked.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = ranked.withColumn("price", (F.sum("source_size").over(every) * PERCENT / 100.0 - F.col("filled")) / F.col("left_weight"))
    # the price of the first source that it doesn't fill holds for all that follow
    open_ = F.when(F.col("price") * F.col("weight") <= F.col("most"), F.struct("place", "price"))
    ranked = ranked.withColumn("first", F.first(open_, ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("first").isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.col("first.price") * F.col("weight")))
    return ranked.select("source", "source_size", target.alias("target"))


def plan(slim: DataFrame) -> DataFrame:
    """source, source_size, target, times (whole takes) and threshold: hashes of at most this are taken once more."""
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(sizes)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    aims = aims.withColumn("times", times).withColumn("budget", F.col("target") - F.col("times") * F.col("source_size"))
    # one row per source; written at each level, as a plan that names it several times would double with each
    state = cut(aims.withColumn("prefix", F.lit("")).withColumn("below", F.lit(0).cast("long")), "mix-targets")
    for level in range(1, LEVELS + 1):
        inside = slim
        if level > 1:  # by source and bucket, so a hot source is dealt by its buckets
            bucket = F.substring("hash", 1, (level - 1) * DIGITS)
            inside = slim.join(state.select(F.col("source").alias("s"), "prefix"), F.col("source").eqNullSafe(F.col("s")) & (bucket == F.col("prefix")))
        buckets = inside.groupBy("source", F.substring("hash", 1, level * DIGITS).alias("bucket")).agg(F.sum("size").alias("n"))
        running = buckets.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")))
        state = state.withColumnRenamed("source", "s").drop("prefix")
        # the first bucket that ends beyond the budget holds the threshold
        over = running.join(state.select("s", "budget", F.col("below").alias("b")), F.col("source").eqNullSafe(F.col("s"))).where(F.col("b") + F.col("upto") > F.col("budget"))
        at = over.groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("b") + F.col("upto") - F.col("n")).alias("start"), "n"), "bucket").alias("at"))
        found = state.join(at, F.col("s").eqNullSafe(F.col("source")), "left").select(
            F.col("s").alias("source"), "source_size", "target", "times", "budget", F.col("at.bucket").alias("prefix"), F.col("at.start").alias("below"), F.col("at.n").alias("n")
        )
        state = cut(found, "mix-bounds")
    takes_last = F.col("below") + F.col("n") - F.col("budget") < F.col("budget") - F.col("below")
    # without a budget nothing is taken once more, documents of size 0 neither
    threshold = F.when(F.col("budget") > 0, F.col("prefix"))
    return state.select("source", "source_size", "target", "times", threshold.alias("threshold"), F.coalesce(takes_last, F.lit(False)).alias("takes_last"))


def _small(chosen: DataFrame) -> DataFrame:
    """The plan, written once; broadcast if its number of sources allows, so that a source with many rows isn't dealt to one task."""
    chosen = cut(chosen, "mix-plan")
    return F.broadcast(chosen) if chosen.count() <= FEW_SOURCES else chosen


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, source, text hash, size, source_size, target, times (0, 1 or 2) and taken for every row of ``docs``."""
    slim = cut(docs.select("doc_id", "source", word_count("text").alias("size"), hashed().alias("hash")), "mix-sizes")
    chosen = _small(plan(slim).withColumnRenamed("source", "s"))
    once = (F.col("hash") < F.col("threshold")) | ((F.col("hash") == F.col("threshold")) & F.col("takes_last"))
    rows = slim.join(chosen, F.col("source").eqNullSafe(F.col("s")))
    rows = rows.withColumn("times", F.col("times") + F.coalesce(once, F.lit(False)).cast("int"))
    return rows.select("doc_id", "source", "hash", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, each as often as it takes them, with the columns of ``docs``."""
    slim = cut(docs.select("source", word_count("text").alias("size"), hashed().alias("hash")), "mix-sizes")
    own = docs.columns
    # one column beside those of docs, by a name that none of them has
    put = fresh_name("mix", own)
    chosen = _small(plan(slim).select(F.struct("source", "times", "threshold", "takes_last").alias(put)))
    once = (hashed() < F.col(f"{put}.threshold")) | ((hashed() == F.col(f"{put}.threshold")) & F.col(f"{put}.takes_last"))
    rows = docs.join(chosen, F.col("source").eqNullSafe(F.col(f"{put}.source")))
    copies = F.col(f"{put}.times") + F.coalesce(once, F.lit(False)).cast("int")
    return rows.withColumn(put, F.explode(F.array_repeat(F.lit(1), copies))).select(*own)


MIX_ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 12) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS most FROM r),
f AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS filled,
             (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS left_weight,
             (sum(source_size) OVER ())::DOUBLE * 150 / 100.0::DOUBLE AS wanted FROM w),
p AS (SELECT *, (wanted - filled) / left_weight AS price FROM f),
o AS (SELECT min_by(price, most::DOUBLE / weight) AS price FROM p WHERE price * weight <= most),
t AS (SELECT source, source_size, least(most::DOUBLE, coalesce((SELECT price FROM o) * weight, most)) AS target FROM p),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
b AS (SELECT *, target - times * source_size AS budget FROM u),
c AS (SELECT source, h, sum(size)::BIGINT AS n FROM d GROUP BY source, h),
e AS (SELECT c.*, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM c),
x AS (SELECT e.source, min(e.h) AS th, min_by(e.upto, e.h) AS upto, min_by(e.n, e.h) AS n FROM e JOIN b ON e.source IS NOT DISTINCT FROM b.source WHERE e.upto > b.budget GROUP BY e.source)
SELECT d.doc_id, d.size, b.source_size, b.target,
  d.size * (b.times + CASE WHEN d.h < x.th OR (d.h = x.th AND x.upto - b.budget < b.budget - (x.upto - x.n)) THEN 1 ELSE 0 END) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""
