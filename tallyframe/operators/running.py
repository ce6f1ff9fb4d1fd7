"""Sums and numbers that run over all rows in one order, without one task for all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import written


def running_over_all(df: DataFrame, order: Sequence[str], sums: Mapping[str, Column], number: str | None = None, before: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with a running sum for each of ``sums``, a row's number from 1 as ``number``, and by ``before`` the value of a column in the row before.

    Rows are dealt to partitions by ranges of ``order`` (which must tell rows apart, else equal rows stand in any order) and written; each
    partition is summed, and what all earlier ones hold is added to its own running sums. The driver sees one row for each partition.
    NULLs come first and add nothing.
    """
    spark, sums, before = df.sparkSession, dict(sums), dict(before or {})
    named = {f"_s{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(sums.values())} | {"_n": F.lit(1).cast("long")}
    parts = df.withColumns(named).repartitionByRange(*(F.col(c).asc() for c in order)).withColumn("_p", F.spark_partition_id())
    parts = written(parts, "ranges")
    totals = parts.groupBy("_p").agg(*(F.sum(c).alias(c) for c in named), *(F.max_by(c, F.struct(*order)).alias(f"_b{i}") for i, c in enumerate(before.values()))).orderBy("_p").collect()
    carried, held, last = [], dict.fromkeys(named), (None,) * len(before)
    for row in totals:
        carried.append((row["_p"], *held.values(), *last))
        held = {c: row[c] if held[c] is None else held[c] + row[c] for c in named}
        last = tuple(row[f"_b{i}"] for i in range(len(before)))
    names = ["_p", *(f"_c{c}" for c in named), *(f"_l{i}" for i in range(len(before)))]
    kinds = ["int", *(parts.agg(F.sum(c)).schema[0].dataType.simpleString() for c in named), *(df.schema[c].dataType.simpleString() for c in before.values())]
    carry = spark.createDataFrame(carried, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    rows = parts.join(F.broadcast(carry), "_p")  # one row for each partition
    over = Window.partitionBy("_p").orderBy(*order)
    upto = over.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({name: F.sum(f"_s{i}").over(upto) + F.coalesce(f"_c_s{i}", F.lit(0)) for i, name in enumerate(sums)})
    if number:
        out = out.withColumn(number, F.row_number().over(over) + F.coalesce("_c_n", F.lit(0)))
    first = F.row_number().over(over) == 1
    out = out.withColumns({name: F.when(first, F.col(f"_l{i}")).otherwise(F.lag(c).over(over)) for i, (name, c) in enumerate(before.items())})
    return out.select(*df.columns, *sums, *([number] if number else []), *before)


def numbered(df: DataFrame, key: str, number: str = "number") -> DataFrame:
    """The distinct keys (NULL has none) with dense numbers from 0 in their order."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return running_over_all(keys, [key], {}, number).withColumn(number, F.col(number) - 1)
