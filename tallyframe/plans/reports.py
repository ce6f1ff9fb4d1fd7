"""Read models over the products: detail documents, explorers, queues, reliability and case studies; columns are arguments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import safe_divide
from ..operators.relational import at_latest, distinct_where


def build_detail_documents(records: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, Sequence[str], Sequence[str]]]) -> DataFrame:
    """One nested document per record: each child table as a list of structs in its order; a record without children has empty lists.

    ``children`` maps a list's name to its table, the columns that order it, and the columns shown. Children are grouped once
    each and joined by key, so the work is that of one shuffle per table, for all records at once.
    """
    out = records
    for name, (table, order, columns) in children.items():
        rows = F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("v"))))
        listed = table.groupBy(key).agg(F.transform(rows, lambda r: r["v"]).alias(name))
        out = out.join(listed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))
    return out


def build_explorer(records: DataFrame, key: str, sites: DataFrame, state: str, usable: Column) -> DataFrame:
    """Records with the sorted list of their usable sites' states, NULL without any, and the number of these sites."""
    per = sites.where(usable).groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(state)), ", ").alias("site_states"), F.count("*").alias("n_sites"))
    return records.join(per, key, "left").withColumn("n_sites", F.coalesce("n_sites", F.lit(0)))


def build_related(records: DataFrame, key: str, one: DataFrame, factors: Mapping[str, tuple[Column, float]], candidate: Sequence[str], order: Sequence[Column], most: int, top: int, least: float = 0.0) -> DataFrame:
    """The ``top`` records related to one: candidates share a factor of ``candidate``, the ``most`` best in ``order`` are scored by weight.

    ``one`` is the one row asked for, with names of its own; ``most`` and ``top`` are limits of the report itself.
    """
    share = reduce(lambda a, b: a | b, (factors[c][0] for c in candidate))
    found = records.join(F.broadcast(one), share).orderBy(*order, key).limit(most)
    score = F.round(reduce(lambda a, b: a + b, (F.when(c, w).otherwise(0.0) for c, w in factors.values())), 4)
    return found.select(key, score.alias("score")).where(F.col("score") >= least).orderBy(F.col("score").desc(), key).limit(top)


def build_node_counts(rows: DataFrame, node: str, key: str, active: Column) -> DataFrame:
    """Distinct records per node, all and active."""
    return distinct_where(rows, [node], key, {"total": F.lit(True), "active": active})


def build_drill_through(history: DataFrame, date: str, segment: Column, columns: Sequence[str]) -> DataFrame:
    """Distinct records of a segment at the latest date."""
    return at_latest(history, date).where(segment).select(*columns).distinct()


def build_owner_landscape(rows: DataFrame, owner: str, key: str, kind: str, names: tuple[str, str, str], top: int) -> DataFrame:
    """The ``top`` owners by distinct records, with the number and the sorted list of their kinds."""
    per = rows.groupBy(owner).agg(F.countDistinct(key).alias(names[0]), F.sort_array(F.collect_set(kind)).alias("_k"))
    return per.select(owner, names[0], F.size("_k").cast("long").alias(names[1]), F.array_join("_k", ", ").alias(names[2])).orderBy(F.col(names[0]).desc(), owner).limit(top)


def build_overview(*figures: tuple[DataFrame, Sequence[Column]]) -> DataFrame:
    """One row of named figures, each group of them from one pass over its table."""
    rows = [table.agg(*columns) for table, columns in figures]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), rows)  # one row each


def build_scoped_counts(history: DataFrame, active: Column, group: Column, name: str, date: str, key: str) -> DataFrame:
    """Distinct active records per group and date."""
    return history.where(active).groupBy(group.alias(name), date).agg(F.countDistinct(key).alias("n"))


def build_rollup(per: DataFrame, by: Sequence[str], date: str, count: str, names: tuple[str, str, str] = ("total", "most", "first_at_most")) -> DataFrame:
    """Sum and maximum of the counts of each group, and the first date that reaches the maximum."""
    first = F.min_by(date, F.struct(-F.col(count), F.col(date)))
    return per.groupBy(*by).agg(F.sum(count).alias(names[0]), F.max(count).alias(names[1]), first.alias(names[2]))


def build_audit_observations(history: DataFrame, date: str, days: int, metrics: Mapping[str, Column], columns: Sequence[str]) -> DataFrame:
    """Observations of the last ``days`` days that count for a metric, with the first that applies."""
    newest = F.broadcast(history.agg(F.date_sub(F.max(date), days).alias("_since")))  # one row
    metric = F.coalesce(*(F.when(c, F.lit(n)) for n, c in metrics.items()))
    return history.crossJoin(newest).where(F.col(date) >= F.col("_since")).withColumn("metric", metric).where("metric IS NOT NULL").select(*columns)


def build_gap_matrix(rows: DataFrame, area: str, kind: str, kinds: Mapping[str, object], far: Column, gap: float) -> DataFrame:
    """Share of far rows by area and kind as a matrix, and whether any cell of the area is a gap."""
    per = rows.groupBy(area, kind).agg(safe_divide(F.count_if(far), F.count("*")).alias("share"))
    cells = (F.max(F.when(F.col(kind) == v, F.round("share", 8))).alias(n) for n, v in kinds.items())
    return per.groupBy(area).agg(*cells, F.bool_or(F.col("share") > gap).alias("any_gap"))


def build_rate_view(rates: DataFrame, keys: Sequence[str], known: Column, better: str, other: str) -> DataFrame:
    """The better of two rates where its denominator is known, and which it is."""
    return rates.select(*keys, F.when(known, F.col(better)).otherwise(F.col(other)).alias("shown"), F.when(known, better).otherwise(other).alias("unit"))


def build_tercile_outcomes(history: DataFrame, key: str, date: str, status: str, active: Column, outcomes: Mapping[str, object], few: int) -> DataFrame:
    """What became of active records at their next observation, by tercile of the day's density."""
    h = history.select(key, date, status, F.lead(status).over(Window.partitionBy(key).orderBy(date)).alias("_next"))
    density = h.groupBy(date).agg(F.count_if(active).alias("_density"))
    density = density.select(date, F.ntile(3).over(Window.orderBy("_density", date)).cast("long").alias("tercile"))  # one row per day
    rows = h.where(active & F.col("_next").isNotNull()).join(density, date)
    rates = (F.round(F.avg((F.col("_next") == v).cast("int")), 8).alias(n) for n, v in outcomes.items())
    return rows.groupBy("tercile").agg(F.count("*").alias("n"), *rates, (F.count("*") < few).alias("inconclusive"))


def build_case_study(rows: DataFrame, area: Column, name: str, category: Column, key: str) -> DataFrame:
    """Rows by area and category with one sample record each (the least key) and the area's total to reconcile with."""
    per = rows.groupBy(area.alias(name), category.alias("category")).agg(F.count("*").alias("n"), F.min(key).alias("sample_key"))
    return per.withColumn("region_total", F.sum("n").over(Window.partitionBy(name)))


def build_priority_queue(rows: DataFrame, segment: Sequence[str], key: str, overlapped: Column, good: Column, usable: Column) -> DataFrame:
    """Records per segment, the share that overlap, and completeness: half the share of good rows, half that of usable ones."""
    per_key = rows.groupBy(*segment, key).agg(F.bool_or(overlapped).alias("_o"), F.count_if(good).alias("_g"), F.count_if(usable).alias("_u"), F.count("*").alias("_n"))
    per = per_key.groupBy(*segment).agg(F.count("*").alias("n"), F.count_if("_o").alias("_o"), *(F.sum(c).alias(c) for c in ("_g", "_u", "_n")))
    share = lambda c: safe_divide(F.col(c), F.col("_n"))
    return per.select(*segment, "n", F.round(safe_divide(F.col("_o"), F.col("n")), 8).alias("overlap_share"), F.round(0.5 * share("_g") + 0.5 * share("_u"), 8).alias("completeness"))


def build_reporting_coverage(rows: DataFrame, segment: Sequence[str], key: str, reports: Mapping[str, Column]) -> DataFrame:
    """Records per segment and the share of them that report each thing in some row."""
    per = rows.groupBy(*segment, key).agg(*(F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in reports.items()))
    return per.groupBy(*segment).agg(F.count("*").alias("n"), *(F.round(F.avg(F.col(n).cast("int")), 8).alias(n) for n in reports))


def build_reliability(rows: DataFrame, run: Column, name: str, shares: Mapping[str, Column], entity: str, distinct: str, key: str) -> DataFrame:
    """Per run: rows, shares of rows with a fault, distinct entities, and whether the key is unique."""
    listed = (F.round(safe_divide(F.count_if(c), F.count("*")), 8).alias(n) for n, c in shares.items())
    return rows.groupBy(run.alias(name)).agg(F.count("*").alias("n"), *listed, F.countDistinct(entity).alias(distinct), (F.count("*") == F.countDistinct(key)).alias("keys_unique"))


def build_reliability_trend(rows: DataFrame, run: Column, name: str, fault: Column, share: str) -> DataFrame:
    """A fault's share per run and its change from the run before."""
    per = rows.groupBy(run.alias(name)).agg(safe_divide(F.count_if(fault), F.count("*")).alias("_s"))
    change = F.col("_s") - F.lag("_s").over(Window.orderBy(name))  # one row per run
    return per.select(name, F.round("_s", 8).alias(share), F.round(change, 8).alias("change"))


def build_recount(counts: DataFrame, again: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Two independent counts side by side: ``keys``, ``value``, ``recount`` and whether they agree; a key that one side lacks doesn't."""
    other = again.select(*(F.col(c).alias(f"_{c}") for c in keys), F.col(value).alias("recount"))
    rows = counts.select(*keys, value).join(other, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys)), "full")
    return rows.select(*(F.coalesce(c, f"_{c}").alias(c) for c in keys), value, "recount", F.col(value).eqNullSafe(F.col("recount")).alias("agrees"))


def build_grouped_trend(rows: DataFrame, scope: str, run: str, share: str) -> DataFrame:
    """A share per run of each scope and its change from the scope's run before."""
    change = F.col(share) - F.lag(share).over(Window.partitionBy(scope).orderBy(run))
    return rows.select(scope, run, F.round(share, 8).alias(share), F.round(change, 8).alias("change"))


def build_top_rows(rows: DataFrame, columns: Sequence[str], order: Sequence[Column], top: int) -> DataFrame:
    """The first ``top`` rows of a report; ``order`` must tell rows apart."""
    return rows.orderBy(*order).limit(top).select(*columns)


def build_latest_month(rows: DataFrame, month: str, by: Sequence[str], sums: Sequence[str], where: Column | None = None) -> DataFrame:
    """Sums of a filtered product over its latest month (of those that the filter leaves), by group."""
    kept = rows if where is None else rows.where(where)
    return at_latest(kept, month).groupBy(month, *by).agg(*(F.sum(c).alias(c) for c in sums))


def build_matches_shown(matches: DataFrame, records: DataFrame, key: str, match: str, columns: Sequence[str]) -> DataFrame:
    """Matches with the columns of both records, ``match_`` before those of the match; a match whose record is gone has NULLs."""
    own = records.select(key, *columns)
    other = records.select(F.col(key).alias("_match"), *(F.col(c).alias(f"match_{c}") for c in columns))
    return matches.join(own, key, "left").join(other, F.col(match) == F.col("_match"), "left").drop("_match")
