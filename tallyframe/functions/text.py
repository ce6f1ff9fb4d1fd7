"""Text normalisation and classification as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The suffixes of place names that a gazetteer adds, longest first.
PLACE_SUFFIXES = ("metropolitan government", "consolidated government", "unified government", "municipality", "city", "town", "village", "borough", "CDP")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_text(c: Column) -> Column:
    """Apostrophes dropped, lower case, every other run of non-ASCII-alphanumerics one space; blank is NULL."""
    plain = F.lower(F.regexp_replace(c, "['’]", ""))
    return blank_to_null(F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " ")))


def normalize_text_unicode(c: Column) -> Column:
    """Lower case, every run of what is neither letter, digit nor underscore (in any script) one space; blank is NULL."""
    return blank_to_null(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " ")))


def surrogate_key(*parts: Column) -> Column:
    """md5 over the parts' text, NULL spelled out so that it differs from the empty text."""
    return F.md5(F.concat_ws("||", *(F.coalesce(p.cast("string"), F.lit("__null__")) for p in parts)))


def strip_suffix(c: Column, suffixes: Sequence[str] = PLACE_SUFFIXES) -> Column:
    return F.regexp_replace(c, rf"(?i) ({'|'.join(suffixes)})$", "")


def clean_label(c: Column, prefixes: Sequence[str] = ("RACE:", "ETHNICITY:")) -> Column:
    """Upper case, single spaces, one known prefix removed."""
    upper = F.trim(F.regexp_replace(F.upper(c), r"\s+", " "))
    return F.trim(F.regexp_replace(upper, rf"^({'|'.join(prefixes)})\s*", ""))


def classify_first(c: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first rule (pattern, label) whose pattern is found."""
    out = None
    for pattern, label in rules:
        hit = c.rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def consumer_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+", " "))


def lookup(c: Column, values: dict[str, str], default: str | None = None) -> Column:
    """A bounded mapping as an expression: no join."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit(default))


def state_code(c: Column, names: dict[str, str], unknown: str = "UNKNOWN") -> Column:
    """A known two-letter code, else the code of a known name, else ``unknown``."""
    cleaned = normalize_text_unicode(c)
    return F.when(F.upper(cleaned).isin(*sorted(set(names.values()))), F.upper(cleaned)).otherwise(lookup(cleaned, names, unknown))


def geo_scope(facility: Column, city: Column, state: Column, country: Column, unknown: str = "UNKNOWN") -> Column:
    """The finest part of a place that is known: facility, city, state, country or unknown."""
    given = lambda c: c.isNotNull() & (c != "")
    return F.when(given(facility), "facility").when(given(city), "city").when(state != unknown, "state").when(given(country), "country").otherwise("unknown")


def in_country(country: Column, spellings: Sequence[str]) -> Column:
    return F.coalesce(normalize_text_unicode(country).isin(*spellings), F.lit(False))


def explanation(*parts: tuple[Column, Column], sep: str = "; ") -> Column:
    """The texts whose condition holds, joined."""
    return F.concat_ws(sep, *(F.when(condition, text) for condition, text in parts))


def nested_flag(*issues: tuple[Column, str]) -> Column:
    """Comma-joined codes of the conditions that hold, or ``ok``."""
    return F.coalesce(blank_to_null(F.concat_ws(",", *(F.when(c, code) for c, code in issues))), F.lit("ok"))
