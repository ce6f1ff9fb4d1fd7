"""Shares, intervals, distances, ages and bands as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES = 3958.8
Z95 = 1.96
#: Years in one unit of age.
AGE_UNITS = {"year": 1.0, "month": 1 / 12, "week": 7 / 365.25, "day": 1 / 365.25, "hour": 1 / (365.25 * 24), "minute": 1 / (365.25 * 24 * 60)}


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper 95 % bounds of a share, inside 0 and 1; NULL without observations."""
    n, p = n.cast("double"), safe_divide(hits, n)
    middle, spread = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), (middle - spread) / (1 + z * z / n))), F.when(some, F.least(F.lit(1.0), (middle + spread) / (1 + z * z / n)))


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; NULL if a point is missing (greatest and least would skip the NULL)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(a.isNotNull(), 2 * EARTH_MILES * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a)))))


def parse_age_years(c: Column) -> Column:
    """'18 Months' and the like to years; anything else NULL."""
    pattern = r"(?i)^\s*(\d+(?:\.\d+)?)\s*(year|month|week|day|hour|minute)s?\s*$"
    unit = F.create_map(*(F.lit(x) for kv in AGE_UNITS.items() for x in kv))
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1).try_cast("double") * F.element_at(unit, F.lower(F.regexp_extract(c, pattern, 2))))


def age_bounds(low: Column, high: Column) -> Column:
    """unbounded, minimum_only, maximum_only, range or contradictory."""
    return (
        F.when(low.isNull() & high.isNull(), "unbounded").when(high.isNull(), "minimum_only").when(low.isNull(), "maximum_only")
        .when(low > high, "contradictory").otherwise("range")
    )


def age_matches(low: Column, high: Column, age: float) -> Column:
    """A bound that isn't stated never excludes."""
    return (low.isNull() | (low <= age)) & (high.isNull() | (high >= age))


def banded(c: Column, bands: Sequence[tuple[float, str]], top: str, inclusive: bool = False) -> Column:
    """The name of the first band whose limit is above (or equal to, if ``inclusive``) the value; NULL stays NULL."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for limit, name in bands:
        out = out.when((c <= limit) if inclusive else (c < limit), name)
    return out.otherwise(top)


def quartile_of_unit(c: Column) -> Column:
    return F.least(F.lit(4), F.floor(c / 0.25).cast("int") + 1)


def rate_per(c: Column, base: Column, per: float, digits: int = 4) -> Column:
    return F.round(safe_divide(c, base) * per, digits)


def head_count(value: Column, unit: Column, kind: Column) -> Column:
    """A count of participants: digits only, with a participant unit and a counting parameter."""
    return F.when(value.rlike("^[0-9]+$") & F.lower(unit).contains("participant") & F.upper(kind).contains("COUNT"), value.try_cast("long"))
