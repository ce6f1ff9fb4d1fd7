"""Distinct counts that add up: per segment the bitmaps of its numbered keys, from which any union of segments is counted.

A bitmap holds 32,768 numbers in 4 KB; a segment has a row for each range of numbers in which it has a key. Counting a union
reads bitmaps, never the rows they came from, and keys are exact, not estimated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import numbered
from .stages import written


def build_key_bitmaps(rows: DataFrame, segment: Sequence[str], key: str) -> tuple[DataFrame, DataFrame]:
    """The bitmaps (segment columns, ``bucket``, ``bits``) of each segment's keys, and the numbers of the keys (``key``, ``number``).

    Rows with a NULL key count nowhere; NULLs in segment columns are segments. Pairs of segment and key are made distinct
    before they meet the numbers, so a key with very many rows is one row by then.
    """
    numbers = written(numbered(rows, key), "key-numbers")
    held = rows.select(*segment, key).where(F.col(key).isNotNull()).distinct().join(numbers, key)
    bits = held.groupBy(*segment, F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    return bits, numbers


def add_keys(bitmaps: DataFrame, more: DataFrame, segment: Sequence[str]) -> DataFrame:
    """Two tables of bitmaps over the same numbers as one."""
    return bitmaps.unionByName(more).groupBy(*segment, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_in(bitmaps: DataFrame, by: Sequence[str], flags: dict[str, Column] | None = None) -> DataFrame:
    """Distinct keys of the union of segments that agree in ``by``, as ``n``; or one count for each of ``flags``, conditions on segment columns.

    A segment belongs to several scopes if it is joined with a table of them first: their counts need no new look at keys.
    """
    flags = flags or {"n": F.lit(True)}
    united = bitmaps.groupBy(*by, "bucket").agg(*(F.bitmap_or_agg(F.when(F.coalesce(c, F.lit(False)), F.col("bits"))).alias(n) for n, c in flags.items()))
    return united.groupBy(*by).agg(*(F.coalesce(F.sum(F.bitmap_count(n)), F.lit(0)).alias(n) for n in flags))
