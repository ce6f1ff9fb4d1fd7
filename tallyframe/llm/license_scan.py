"""Licence notices in texts, by patience alignment with known templates.

Text and template are runs of ASCII letters and digits, in lower case. A region of the text is aligned with a template
by the words that occur once in each: the longest run of them in the order of both (a longest increasing subsequence)
are anchors, and the gaps between anchors are aligned in the same way. Coverage is the share of the template's words
that are aligned; a notice is found where it is at least COVERAGE and the words that tell the template from others
(names of licences and their versions) are all aligned, with nothing else between them and no further version digit.

Regions are exact, not a guess: each template has key words, its longest, that make up more than 1 - COVERAGE of it, so
any notice has one of them; of a template with a distinguishing word, which every notice has, that word alone. The text within a template's length around a key word is a region. It is aligned from that
word on, which stands for each of its places in the template in turn, once as it is and once cut where the key word comes
more often than the template has it, so that a notice that is repeated is found each time, however close the copies stand.

Defined results: a null or empty text has no notices; a null doc_id is kept; rows that repeat are scanned each; an empty
table gives no rows; other columns are ignored. Of equal coverages of one licence the earlier start counts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .base import map_rows
from .license_templates import CORE, FILL, NAMING, TEMPLATES

COVERAGE = 0.8
PERCENT = round(100 * COVERAGE)
#: A notice may be so many times as long as its template.
STRETCH = 1.25

_TOKEN = re.compile(r"[A-Za-z0-9]+")
_V = re.compile(r"^v(?=[0-9]+$)")
_MORE = re.compile(r"\.[0-9]*[1-9]")

RESULT = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("license", StringType()),
        StructField("coverage", DoubleType()),
        StructField("aligned_words", LongType()),
        StructField("start", LongType()),
        StructField("end", LongType()),
        StructField("n_notices", LongType()),
        StructField("notices", StringType()),
    ]
)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first, whose second increases too: patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        before.append(piles[at - 1] if at else -1)
        tops[at : at + 1], piles[at : at + 1] = [j], [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: list[str], b: list[str], a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Places of aligned words of ``a`` and ``b``, in order."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(a0 + i, b0 + i) for i in range(head)]
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    count_a, count_b = Counter(mid_a), Counter(mid_b)
    place = {w: j for j, w in enumerate(mid_b) if count_b[w] == 1}
    anchors = increasing([(i, place[w]) for i, w in enumerate(mid_a) if w in place and count_a[w] == 1])
    i0 = j0 = 0
    for i, j in [*anchors, (len(mid_a), len(mid_b))] if anchors else []:
        out += align(mid_a[i0:i], mid_b[j0:j], a0 + head + i0, b0 + head + j0)
        if i < len(mid_a):
            out.append((a0 + head + i, b0 + head + j))
        i0, j0 = i + 1, j + 1
    return out + [(a0 + len(a) - tail + i, b0 + len(b) - tail + i) for i in range(tail)]


def words_of(text: str) -> list[str]:
    """In lower case; v3 counts as 3."""
    return [_V.sub("", w.lower()) for w in _TOKEN.findall(text)]


def fixed_runs(words: list[str]) -> list[tuple[int, int]]:
    """Runs of naming words and numbers that tell the template from others; of those that say nothing new, the first only."""
    out, known, j = [], set(), 0
    while j < len(words):
        upto = j
        while upto < len(words) and (words[upto] in NAMING or words[upto].isdigit()):
            upto += 1
        if new := {w for w in words[j:upto] if w in CORE or w.isdigit()} - known:
            known |= new
            out.append((j, upto))
        j = max(upto, j + 1)
    return out


@lru_cache(maxsize=4)
def prepared(templates: tuple[tuple[str, str], ...]) -> tuple[list[tuple[str, list[str], list[tuple[int, int]], dict[str, list[int]]]], set[str]]:
    """Licence, words, fixed runs and key words (with their places) of each template, and all key words."""
    out = []
    for name, text in templates:
        words = words_of(text)
        runs = fixed_runs(words)
        count, keys, have = Counter(words), {}, 0
        own = [w for a, b in runs for w in words[a:b] if w in CORE]
        for w in [max(own, key=lambda w: (len(w), w))] if own else sorted(count, key=lambda w: (-len(w), count[w], w)):
            if 100 * have > (100 - PERCENT) * len(words):
                break
            keys[w] = [j for j, x in enumerate(words) if x == w]
            have += count[w]
        out.append((name, words, runs, keys))
    return out, set().union(*(k for *_, k in out))


class Text:
    """Words and their places in a text."""

    def __init__(self, text: str):
        self.text, self.words = text, words_of(text)

    @cached_property
    def spans(self) -> list[tuple[int, int]]:
        return [m.span() for m in _TOKEN.finditer(self.text)]

    def holds(self, runs: list[tuple[int, int]], pairs: list[tuple[int, int]], template: list[str]) -> bool:
        """Whether all words of the runs are aligned with only fillers between, and numbers go on neither side."""
        place = {j: i for i, j in pairs}
        for a, b in runs:
            if any(j not in place for j in range(a, b)):
                return False
            for j in range(a, b):
                i = place[j]
                if j > a and not FILL.issuperset(self.words[place[j - 1] + 1 : i]):
                    return False
                if template[j][-1].isdigit():
                    begin, end = self.spans[i]
                    if (j + 1 == b or not template[j + 1].isdigit()) and _MORE.match(self.text, end):
                        return False
                    if (j == a or not template[j - 1][-1].isdigit()) and self.text[begin - 1 : begin] == "." and self.text[max(0, begin - 2) : begin - 1].isdigit():
                        return False
        return True


def best_notice(pairs: list[tuple[int, int]], template: list[str], i: int) -> list[tuple[int, int]] | None:
    """The part of an alignment with most words that has place ``i`` and isn't stretched too far, if it covers the template."""
    most, best, at = int(STRETCH * len(template)) + 2, (0, 0), 0
    for k in range(len(pairs)):
        while pairs[k][0] - pairs[at][0] >= most:
            at += 1
        if k - at + 1 > best[1] - best[0] and pairs[at][0] <= i <= pairs[k][0]:
            best = (at, k + 1)
    return pairs[slice(*best)] if 100 * (best[1] - best[0]) >= PERCENT * len(template) else None


def notice_at(text: Text, low: int, high: int, same: list[int], n: int, template: list[str], runs: list[tuple[int, int]], places: list[int]) -> tuple[float, int, int, int] | None:
    """Coverage, aligned words, first and last place of the best notice that has the key word at ``same[n]``.

    ``same`` are the key word's places in the text, ``places`` those in the template.
    """
    i, words, best = same[n], text.words, None
    for r, j in enumerate(places):
        # r of the template's key words stand before this one
        left = same[n - r - 1] + 1 if n > r else 0
        right = same[n + len(places) - r] if n + len(places) - r < len(same) else len(words)
        for a, b in dict.fromkeys([(max(low, left), min(high, right)), (low, high)]):
            pairs = [*align(words[a:i], template[:j], a), (i, j), *align(words[i + 1 : b], template[j + 1 :], i + 1, j + 1)]
            if (part := best_notice(pairs, template, i)) and text.holds(runs, part, template):
                hit = (len(part) / len(template), len(part), part[0][0], part[-1][0])
                if best is None or (-hit[1], hit[3] - hit[2], hit[2]) < (-best[1], best[3] - best[2], best[2]):
                    best = hit
    return best


def notices(text: str | None, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[tuple[str, float, int, int, int]]:
    """Licence, coverage, aligned words, start and end (code points) of each notice; of those that overlap, the best covered."""
    known, every_key = prepared(templates)
    whole = Text(text or "")
    found = whole.words
    if every_key.isdisjoint(found):
        return []
    at: dict[str, list[int]] = {}
    for i, w in enumerate(found):
        if w in every_key:
            at.setdefault(w, []).append(i)
    out = []
    for name, template, runs, keys in known:
        if at.keys().isdisjoint(keys):
            continue
        size, done = int(STRETCH * len(template)) + 2, 0
        wanted = Counter(template)
        for i, w, n in sorted((i, w, n) for w in keys for n, i in enumerate(at.get(w, ()))):
            if i < done:
                continue
            low, high = max(done, i - size), min(len(found), i + size)
            inside = Counter(found[low:high])
            if 100 * sum(min(c, inside[x]) for x, c in wanted.items()) < PERCENT * len(template):
                continue  # too few of its words are here in any order
            if hit := notice_at(whole, low, high, at[w], n, template, runs, keys[w]):
                out.append((name, round(hit[0], 6), hit[1], whole.spans[hit[2]][0], whole.spans[hit[3]][1]))
                done = hit[3] + 1
    kept: list[tuple[str, float, int, int, int]] = []
    for n in sorted(out, key=lambda n: (-n[2], -n[1], n[3], n[0])):
        if all(n[4] <= k[3] or n[3] >= k[4] for k in kept):
            kept.append(n)
    return sorted(kept, key=lambda n: n[3])


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """The best covered notice and the list of all, for every row of ``docs`` (doc_id, text)."""

    def run(doc_ids: pa.Array, texts: pa.Array) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": doc_ids} | {c: [] for c in RESULT.names[1:]}
        for text in texts:
            own = notices(text.as_py(), templates)
            best = min(own, key=lambda n: (-n[1], -n[2], n[3])) if own else (None, 0.0, 0, None, None)
            row = (*best, len(own), ",".join(f"{n}:{c:g}:{a}:{b}" for n, c, _, a, b in own))
            for c, v in zip(RESULT.names[1:], row, strict=True):
                out[c].append(v)
        return out

    return map_rows(docs, ["doc_id", "text"], run, RESULT)
