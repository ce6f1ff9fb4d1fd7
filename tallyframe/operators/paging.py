"""Pages of a sorted table by the last row's key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyset_page(df: DataFrame, value: str, key: str, after: tuple | None = None, size: int = 25, ascending: bool = False) -> DataFrame:
    """The rows after ``after`` (value, key), NULL values last, and one more row that tells whether another page follows."""
    v, k = F.col(value), F.col(key)
    if after is not None:
        last, last_key = after
        if last is None:
            df = df.where(v.isNull() & (k > last_key))
        else:
            beyond = (v > last) if ascending else (v < last)
            df = df.where(beyond | ((v == last) & (k > last_key)) | v.isNull())
    return df.orderBy(v.asc_nulls_last() if ascending else v.desc_nulls_last(), k).limit(size + 1)
