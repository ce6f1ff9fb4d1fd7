"""Similar records: blocked candidates, 0/1 factors times weights, top matches with ranks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stages import written


def score(factors: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Sum of the weights of the factors that hold, rounded to 4 places; a factor that is unknown counts as not holding."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.when(F.coalesce(factors[name], F.lit(False)), weight).otherwise(0.0)
    return F.round(total, 4)


def scored_pairs(pairs: DataFrame, features: DataFrame, key: str, factors: Mapping[str, Column], weights: Mapping[str, float]) -> DataFrame:
    """Candidate pairs (a, b) with their factors (over a_ and b_ columns), score and what they share."""
    a = features.select(F.col(key).alias("a"), *(F.col(c).alias(f"a_{c}") for c in features.columns if c != key))
    b = features.select(F.col(key).alias("b"), *(F.col(c).alias(f"b_{c}") for c in features.columns if c != key))
    shared = F.concat_ws("; ", *(F.when(F.coalesce(c, F.lit(False)), n) for n, c in factors.items()))
    return pairs.join(a, "a").join(b, "b").select("a", "b", score(factors, weights).alias("score"), shared.alias("shared"))


def top_matches(scored: DataFrame, k: int = 25) -> DataFrame:
    over = Window.partitionBy("a").orderBy(F.col("score").desc(), "b")
    return scored.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Factor:
    """A 0/1 factor: all columns of ``equal`` are the same on both sides (NULL is never the same), or ``holds`` of the sides' columns.

    ``holds`` gets two functions that give the column of a name on the first and on the second side.
    """

    name: str
    weight: float
    equal: tuple[str, ...] = ()
    holds: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None

    def of(self, a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        rule = self.holds(a, b) if self.holds else reduce(and_, (a(c) == b(c) for c in self.equal))
        return F.coalesce(rule, F.lit(False))


def overlap(column: str) -> Callable[[Callable[[str], Column], Callable[[str], Column]], Column]:
    return lambda a, b: F.arrays_overlap(a(column), b(column))


def build_top_matches(features: DataFrame, key: str, tokens: str, factors: Sequence[Factor], k: int = 25, most: int = 2000, stats: dict | None = None) -> DataFrame:
    """``key``, ``match``, ``score``, ``rank`` (1 to k), each factor as 0 or 1, and ``shared``: of all records that share a token with a record, the k of highest score, then least key.

    ``features`` has one row per key; ``tokens`` is an array column, and tokens of ``most`` or more records join nothing (a rule of the product).

    Pairs that can't be among the k are not made. Records that agree in every column are one class, of which the k + 1 least keys are enough; classes
    are joined on a token and all ``equal`` factors first, then on ever fewer of them, the lightest left out. A pair that a step doesn't make
    lacks one of its factors, so its score is at most the whole weight less that of the lightest; a class whose (k + 1)-th match is above that is
    settled and leaves the later, coarser steps. ``stats`` gets ``pairs``, the number of pairs of classes made, and ``classes``.
    """
    columns = [c for c in features.columns if c != key]
    same = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    signed = features.withColumn("_class", same)
    first = Window.partitionBy("_class").orderBy(key)
    ids = signed.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1).groupBy("_class").agg(F.sort_array(F.collect_list(key)).alias("_ids"), *(F.first(c).alias(c) for c in columns))
    sizes = signed.groupBy("_class").agg(F.count("*").alias("_n"))
    # from here on a class goes by its least key, which is shorter than its signature
    classes = ids.join(sizes, "_class").withColumnRenamed("_class", "_signature").withColumn("_class", F.col("_ids")[0])
    classes = written(classes, "classes")
    laid = classes.select("_class", "_n", F.explode(F.array_distinct(tokens)).alias("_token")).where("_token IS NOT NULL")
    usable = laid.groupBy("_token").agg(F.sum("_n").alias("_m")).where(F.col("_m") < most).select("_token")
    laid = written(laid.join(usable, "_token").select("_class", "_token"), "class-tokens")

    equal = sorted((f for f in factors if f.equal), key=lambda f: -f.weight)
    whole, made, lists, open_ = sum(f.weight for f in factors), 0, None, classes
    left_of, right_of = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    for upto in range(len(equal), -1, -1):
        on = [c for f in equal[:upto] for c in f.equal]
        bound = round(whole - equal[upto - 1].weight, 4) if upto else None
        side = lambda rows, p: rows.join(laid, "_class").select("_token", *(F.col(c).alias(f"{p}_{c}") for c in ("_class", "_ids", *columns)))
        pairs = side(open_, "a").join(side(classes, "b"), ["_token"]) if not on else side(open_, "a").alias("l").join(
            side(classes, "b").alias("r"), reduce(and_, (F.col(f"a_{c}") == F.col(f"b_{c}") for c in on), F.col("l._token") == F.col("r._token")))
        flags = F.struct(*(f.of(left_of, right_of).alias(f.name) for f in factors))
        pairs = pairs.select("a__class", "b__class", "b__ids", flags.alias("_flags")).dropDuplicates(["a__class", "b__class"])
        total = reduce(lambda s, f: s + F.when(F.col(f"_flags.{f.name}"), f.weight).otherwise(0.0), factors, F.lit(0.0))
        pairs = written(pairs.withColumn("_score", F.round(total, 4)), "class-pairs")
        made += pairs.count() if stats is not None else 0
        near = Window.partitionBy("a__class").orderBy(F.col("_score").desc(), F.col("b__ids")[0])
        # the first k + 1 classes hold the first k + 1 records, as each has a record ahead of all those of later classes
        best = pairs.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= k + 1).select("a__class", "_score", "_flags", F.explode("b__ids").alias("_match"))
        by_record = Window.partitionBy("a__class").orderBy(F.col("_score").desc(), "_match")
        best = best.withColumn("_r", F.row_number().over(by_record)).where(F.col("_r") <= k + 1)
        found = best.groupBy(F.col("a__class").alias("_class")).agg(F.sort_array(F.collect_list(F.struct("_r", "_match", "_score", "_flags"))).alias("_list"))  # k + 1 rows each
        if bound is not None:
            found = found.where((F.size("_list") == k + 1) & (F.element_at("_list", -1)["_score"] > bound))
        found = written(found, "class-matches")
        lists = found if lists is None else lists.unionByName(found)
        open_ = open_.join(found, "_class", "left_anti")
    if stats is not None:
        stats |= {"pairs": made, "classes": classes.count()}
    told = lists.join(classes.select("_class", "_signature"), "_class").select("_signature", "_list")
    rows = signed.select(key, F.col("_class").alias("_signature")).join(told, "_signature")
    others = F.slice(F.filter("_list", lambda x: x["_match"] != F.col(key)), 1, k)
    rows = rows.select(key, F.posexplode(others).alias("_at", "_m"))
    shown = F.concat_ws("; ", *(F.when(F.col(f"_m._flags.{f.name}"), f.name) for f in factors))
    return rows.select(
        key, F.col("_m._match").alias("match"), F.col("_m._score").alias("score"), (F.col("_at") + 1).alias("rank"), *(F.col(f"_m._flags.{f.name}").cast("int").alias(f.name) for f in factors), shown.alias("shared"),
    )


def build_related(
    features: DataFrame, targets: DataFrame, key: str, groups: DataFrame, terms: DataFrame, phase: str, factors: Sequence[Factor], top: int = 10, most: int = 250, least: float | None = None
) -> DataFrame:
    """For each of ``targets`` (key) its ``top`` related records: ``target``, ``key``, ``score``, ``rank``, each factor as 0 or 1, and ``shared``.

    Candidates share a group (``groups``: key, group) or a term (``terms``: key, term, is_ancestor) that is a direct one of at least one side. Of a
    target's candidates the first ``most`` are scored (a rule of the report): same phase before others, then a shared group, then a
    term that is direct on both sides, then one that is direct on one, then by key. The first factor holds where a group is shared. ``features`` has one row per
    key; matches below ``least`` are left out.

    No pair is made that can't be among the ``most``. For every rank of that order there are lists: the records of a phase, group and term, of a phase and
    group, and so on, each of which holds records that have the rank at least. A target reads its lists' ``most`` + 1 least keys only (one may be
    its own): whoever comes later in the list of its own rank has ``most`` others ahead. So work grows with the records and targets, not with their product.
    """
    named = targets.select(F.col(key).alias("target")).distinct()
    features = written(features, "related-features")
    known = features.where(F.col(key).isNotNull()).select(key, F.col(phase).alias("_phase"))
    in_group = groups.where("group IS NOT NULL").select(key, "group").distinct().join(known, key)
    kind = F.when(F.col("is_ancestor"), 1).when(~F.col("is_ancestor"), 0).otherwise(2)  # 2: not known
    has_term = terms.where("term IS NOT NULL").select(key, "term", kind.alias("_kind")).distinct().join(known, key)
    in_both = in_group.join(has_term.drop("_phase"), key)
    # of a direct term a target asks for all its records, of another one for those for which it is direct
    ask = lambda kind, depth: F.struct(F.lit(kind).alias("kind"), F.lit(depth).alias("depth"))
    asked = F.when(F.col("_kind") == 0, F.array(ask(0, 2), ask(1, 1), ask(2, 2))).when(F.col("_kind") == 1, F.array(ask(0, 1))).otherwise(F.array(ask(0, 2)))
    hits = None
    for rows, on in ((in_both, ["group", "term", "_kind"]), (in_group, ["group"]), (has_term, ["term", "_kind"])):
        mine = rows.withColumnRenamed(key, "target").join(named, "target", "left_semi")
        if by_term := "term" in on:
            mine = mine.withColumn("_a", F.explode(asked)).withColumn("_kind", F.col("_a.kind")).withColumn("_depth", F.col("_a.depth"))
        for by in (["_phase", *on], on):
            first = Window.partitionBy(*by).orderBy(key)
            held = (rows.where("_phase IS NOT NULL") if "_phase" in by else rows).select(*by, key).distinct()
            lists = held.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most + 1).groupBy(*by).agg(F.collect_list(key).alias("_keys"))
            found = mine.join(lists, by).select(
                "target", F.explode("_keys").alias(key), F.lit(int("_phase" in by)).alias("_same"), F.lit(int("group" in on)).alias("_group"), (F.col("_depth") if by_term else F.lit(0)).alias("_depth")
            )
            hits = found if hits is None else hits.unionByName(found)
    pool = hits.where(F.col("target") != F.col(key)).groupBy("target", key).agg(*(F.max(c).alias(c) for c in ("_same", "_group", "_depth")))
    first = Window.partitionBy("target").orderBy(F.col("_same").desc(), F.col("_group").desc(), F.col("_depth").desc(), key)
    pool = pool.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    rest = [c for c in features.columns if c != key]
    a = features.select(F.col(key).alias("target"), *(F.col(c).alias(f"a_{c}") for c in rest))
    b = features.select(key, *(F.col(c).alias(f"b_{c}") for c in rest))
    rows = pool.join(a, "target").join(b, key)
    left, right = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    rows = rows.withColumns({f.name: (F.col("_group") == 1) if i == 0 else f.of(left, right) for i, f in enumerate(factors)})
    total = reduce(lambda s, f: s + F.when(F.col(f.name), f.weight).otherwise(0.0), factors, F.lit(0.0))
    rows = rows.withColumn("score", F.round(total, 4))
    if least is not None:
        rows = rows.where(F.col("score") >= least)
    best = Window.partitionBy("target").orderBy(F.col("score").desc(), key)
    rows = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    shown = F.concat_ws("; ", *(F.when(F.col(f.name), f.name) for f in factors))
    return rows.select("target", key, "score", "rank", *(F.col(f.name).cast("int").alias(f.name) for f in factors), shown.alias("shared"))
