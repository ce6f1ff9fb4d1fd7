"""JSON whose shape isn't known: canonical hashes and field paths."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


@F.pandas_udf(StringType())
def canonical_hash(texts: pd.Series) -> pd.Series:
    """sha256 of the document with sorted keys and no spaces; NULL for what isn't JSON."""

    def one(text: str | None) -> str | None:
        try:
            return hashlib.sha256(json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        except (TypeError, ValueError):
            return None

    return texts.map(one)


def paths_of(value: object, depth: int = 3, at: str = "") -> set[str]:
    """Paths of fields down to ``depth``; a list's elements (the first 20) are ``path[]``."""
    if isinstance(value, dict) and depth:
        return {p for k, v in value.items() for p in ({f"{at}.{k}" if at else k} | paths_of(v, depth - 1, f"{at}.{k}" if at else k))}
    if isinstance(value, list):
        return {p for v in value[:20] for p in paths_of(v, depth, f"{at}[]")}
    return set()


@F.pandas_udf(ArrayType(StringType()))
def field_paths(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> list[str] | None:
        try:
            return sorted(paths_of(json.loads(text)))
        except (TypeError, ValueError):
            return None

    return texts.map(one)
