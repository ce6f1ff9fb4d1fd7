"""Line-first cleaning: rules judge each line, failing lines go, and documents that lose too much text are rejected.

A line that has a word fails by the first rule that applies:

* punctuation: over ODD_PERCENT of its words carry a symbol or a doubled exclamation or question mark;
* navigation: over LINK_PERCENT of its words are separators of links or cells, or it is short and made of menu words only;
* boilerplate: it is short and has a stock phrase, or over half of its words repeat the word before.

A document is rejected if it fails the base rules (fewer than MIN_WORDS words, or over half of its words in repeated
3-word windows) or if failing lines hold over LOST_PERCENT of its word characters.

Defined results: a null, empty or blank text has no words and fails the base rules, its clean text is empty; a null
doc_id is kept as it is; rows that repeat are judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from .base import WORD, map_rows

MIN_WORDS = 50
REPEAT_PERCENT = 50
ODD_PERCENT = 30
LINK_PERCENT = 20
SHORT_MENU = 6
SHORT_BOILERPLATE = 40
LOST_PERCENT = 25

# Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
ODD_WORD = r"[#*$%&|<>]|[!?][!?]"
SEPARATORS = ("|", "»", "›", "«", ">", ">>", "·", "•", "::", "/")
MENU_WORDS = ("home", "menu", "login", "logout", "search", "next", "previous", "back", "top", "contact", "about", "help", "sitemap", "share", "print", "more")
PHRASES = (
    "all rights reserved", "click here", "cookie policy", "cookies to", "enable javascript", "lorem ipsum", "powered by", "privacy policy",
    "read more", "share this", "sign up", "skip to content", "subscribe to", "terms of service", "terms of use",
)

_ODD = re.compile(ODD_WORD)
_PHRASE = re.compile("|".join(map(re.escape, PHRASES)))
_MENU = re.compile(rf"(?<![a-z])(?:{'|'.join(MENU_WORDS)})(?![a-z])")
_ANY_SEPARATOR = re.compile("|".join(map(re.escape, SEPARATORS)))
_BLANKS = "\t\n\x0b\x0c\r "
_LOWER = {c: c + 32 for c in range(65, 91)}

RESULT = StructType(
    [
        StructField("doc_id", LongType()),
        *(StructField(c, LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        StructField("base_failed", BooleanType()),
        StructField("kept", BooleanType()),
        *(StructField(c, LongType()) for c in ("n_lines", "n_odd_lines", "n_menu_lines", "n_stock_lines", "lost_chars")),
        StructField("clean_text", StringType()),
    ]
)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def repeated_words(words: list[str]) -> int:
    """Words inside 3-word windows that occur at least twice; windows are told apart by 64-bit hashes."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    x = (h[:-2] * _FACTORS[0]) ^ (h[1:-1] * _FACTORS[1] + (h[2:] ^ (h[2:] >> np.uint64(29))) * _FACTORS[2])
    order = np.argsort(x)
    same = x[order][1:] == x[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(x) + 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice[1:] |= twice[:-1].copy()  # a window covers three words
    first = np.zeros(len(x) + 2, bool)
    first[order[1:][same]] = True
    first[order[:-1][same]] = True
    twice[2:] |= first[:-2]
    return int(twice.sum())


def line_rule(line: str, words: list[str]) -> str | None:
    n = len(words)
    links = sum(w in SEPARATORS for w in words)
    if 100 * links > LINK_PERCENT * n:
        return "menu"
    if 100 * sum(1 for w in words if _ODD.search(w)) > ODD_PERCENT * n:
        return "odd"
    small = [w.translate(_LOWER).strip(".,:;!?") for w in words] if n <= SHORT_MENU else []
    if small and all(w in MENU_WORDS or w in SEPARATORS for w in small):
        return "menu"
    if n <= SHORT_BOILERPLATE and _PHRASE.search(line.translate(_LOWER)):
        return "stock"
    if 2 * sum(map(eq, words, words[1:])) > n:
        return "stock"
    return None


def judge(text: str | None) -> tuple:
    """Everything of RESULT after doc_id."""
    text = text or ""
    words = WORD.findall(text)
    n_words, chars = len(words), len(text) - sum(map(text.count, _BLANKS))
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    repeats = repeated_words(words)
    base_failed = n_words < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * n_words
    found, lost, clean = {"odd": 0, "menu": 0, "stock": 0}, 0, text
    lowered = text.translate(_LOWER) if not text.isascii() else text.lower()
    # No line can fail a rule whose marks the whole text lacks.
    if _ODD.search(text) or _ANY_SEPARATOR.search(text) or _MENU.search(lowered) or _PHRASE.search(lowered) or any(map(eq, words, words[1:])):
        good = []
        for line in text.split("\n"):
            own = WORD.findall(line)
            if own and (rule := line_rule(line, own)):
                found[rule] += 1
                lost += sum(map(len, own))
            else:
                good.append(line)
        clean = "\n".join(good)
    kept = not base_failed and 100 * lost <= LOST_PERCENT * chars
    return (n_words, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, base_failed, kept, len(lines), *found.values(), lost, clean)


def clean_documents(docs: DataFrame) -> DataFrame:
    """The rules' figures, the verdict and the cleaned text of every row of ``docs`` (doc_id, text)."""

    def run(doc_ids: pa.Array, texts: pa.Array) -> dict[str, list]:
        rows = [judge(t.as_py()) for t in texts]
        return {"doc_id": doc_ids, **dict(zip(RESULT.names[1:], zip(*rows, strict=True), strict=True))} if rows else {c: [] for c in RESULT.names}

    return map_rows(docs, ["doc_id", "text"], run, RESULT)


def _listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: The same rules for DuckDB.
RULES_ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) > 1 AS twice FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM b WHERE len(w) > 2)),
n AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE twice) GROUP BY r),
l AS (SELECT r, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS own FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
v AS (SELECT r, line, len(array_to_string(own, '')) AS chars, CASE
    WHEN 100 * len(list_filter(own, lambda x: list_contains({_listed(SEPARATORS)}, x))) > {LINK_PERCENT} * len(own) THEN 'menu'
    WHEN 100 * len(list_filter(own, lambda x: regexp_matches(x, '{ODD_WORD}'))) > {ODD_PERCENT} * len(own) THEN 'odd'
    WHEN len(own) <= {SHORT_MENU} AND len(list_filter(own, lambda x: NOT list_contains({_listed(MENU_WORDS + SEPARATORS)}, trim(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.,:;!?')))) = 0 THEN 'menu'
    WHEN len(own) <= {SHORT_BOILERPLATE} AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{"|".join(PHRASES)}') THEN 'stock'
    WHEN 2 * len(list_filter(range(1, len(own)), lambda i: own[i] = own[i + 1])) > len(own) THEN 'stock' END AS rule FROM l WHERE len(own) > 0),
m AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (WHERE rule = 'odd') AS n_odd_lines, count(*) FILTER (WHERE rule = 'menu') AS n_menu_lines,
    count(*) FILTER (WHERE rule = 'stock') AS n_stock_lines, coalesce(sum(chars) FILTER (WHERE rule IS NOT NULL), 0)::BIGINT AS lost_chars FROM v GROUP BY r),
a AS (SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_odd_lines, 0) AS n_odd_lines, coalesce(n_menu_lines, 0) AS n_menu_lines, coalesce(n_stock_lines, 0) AS n_stock_lines,
    coalesce(lost_chars, 0) AS lost_chars FROM b LEFT JOIN n USING (r) LEFT JOIN m USING (r))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND 100 * lost_chars <= {LOST_PERCENT} * word_chars AS kept FROM a
"""
