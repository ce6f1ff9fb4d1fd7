"""Array expressions that treat NULL elements and empty arrays as stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(a: Column, b: Column) -> Column:
    """Whether two arrays share an element that isn't NULL; false for NULL arrays."""
    return F.coalesce(F.arrays_overlap(F.array_compact(a), F.array_compact(b)), F.lit(False))


def distinct_sorted(c: Column | str) -> Column:
    """Aggregate: the distinct values in order, without NULL."""
    return F.sort_array(F.collect_set(c))


def joined_phases(values: Column) -> tuple[Column, Column]:
    """A list of phases as 'A|B' and 'A/B'; none is NULL and UNKNOWN, NA is NOT_APPLICABLE."""
    raw = F.when(F.size(values) > 0, F.array_join(values, "|"))
    named = F.array_join(F.transform(values, lambda v: F.when(v == "NA", "NOT_APPLICABLE").otherwise(v)), "/")
    return raw, F.when(F.coalesce(F.size(values), F.lit(0)) <= 0, "UNKNOWN").otherwise(named)
