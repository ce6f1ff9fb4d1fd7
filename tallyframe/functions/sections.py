"""Criteria texts as ordered sections of headings and items, by the text's own lines.

A line is taken apart into its mark, its words and whether it ends in a colon; ``RULES`` decides on these parts, the first rule
that holds. Everything is columns: parts are bound once by a one-element ``transform``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that begin a criterion and no heading; qualifiers that a heading behind a mark may have.
LEADS = ("no", "none", "not", "any", "meet", "meets", "fail", "fails", "prior", "previous", "note", "without")
QUALIFIERS = (
    "key", "other", "additional", "main", "general", "specific", "primary", "secondary", "core", "clinical", "angiographic", "ocular", "healthy", "common", "patient", "participant", "cohort",
)
#: Words that name a list, with the list's kind.
NAMES = {"inclusion": "inclusion", "inclusions": "inclusion", "eligibility": "inclusion", "exclusion": "exclusion", "exclusions": "exclusion", "noninclusion": "exclusion", "noninclusions": "exclusion"}
#: Who a list is about, and the words that follow where the list lets them in or keeps them out.
PEOPLE = ("participants", "patients", "subjects")
LET_IN = ("must", "should", "will be included", "are eligible")
KEPT_OUT = ("must not", "may not", "should not", "will be excluded", "are excluded", "are not eligible")

BULLET = r"^\s*(?:[-*•·‣◦–—]|\(?\d{1,3}[.)]|\(\d{1,3}\)|[a-z][.)])\s+"
#: A longer line is no heading.
LONGEST = 300
#: Lines without one of these are no headings; only the others are taken apart.
_HINT = rf"(?i)clusion|eligib|{'|'.join(PEOPLE)}"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _among(word: Column, words) -> Column:
    return word.isin(list(words))


def _parts(line: Column) -> Column:
    """Struct of a line: marked, colon, words (lower case, without stars and brackets), criteria, and the place of the first name of a list (-1: none).

    A title before a colon (up to five words, as in ``Part 2: Inclusion criteria``) isn't part of the words.
    """
    plain = F.trim(F.regexp_replace(F.lower(line), r"\*\*+", " "))
    marked = plain.rlike(BULLET)
    bare = F.trim(F.regexp_replace(F.regexp_replace(plain, BULLET, ""), r"\([^()]*\)|\*", " "))
    colon = bare.rlike("[:：]$")
    pieces = F.filter(F.split(bare, "[:：]"), lambda p: F.length(F.trim(p)) > 0)
    titled = (F.size(pieces) == 2) & (F.size(F.split(F.get(pieces, F.lit(0)), " ")) <= 5)
    own = F.when(titled, F.get(pieces, F.lit(1))).otherwise(F.array_join(pieces, " : "))
    joined = F.regexp_replace(own, r"\bnon[-\s]+inclusion", "noninclusion")
    words = F.filter(F.split(joined, r"[\s,;/-]+"), lambda w: F.length(w) > 0)

    def named(words: Column) -> Column:
        criteria = F.exists(words, lambda w: _among(w, ("criteria", "criterion")))
        rest = F.filter(words, lambda w: ~_among(w, ("criteria", "criterion")))
        first = F.array_position(F.transform(rest, lambda w: _among(w, NAMES)), F.lit(True)).cast("int") - 1
        return F.struct(marked.alias("marked"), colon.alias("colon"), rest.alias("words"), criteria.alias("criteria"), first.alias("at"), F.get(words, F.lit(0)).alias("opening"))

    return _let(words, named)


def _rules(p: Column) -> list[tuple[Column, Column]]:
    """When, and the kind of section that then begins."""
    words, at = p["words"], p["at"]
    before, after = F.slice(words, 1, F.greatest(at, F.lit(0))), F.slice(words, at + 2, F.size(words))
    names = F.transform(F.array_distinct(F.filter(words, lambda w: _among(w, NAMES))), lambda w: F.element_at(F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair)), w))
    kind = F.when(F.size(F.array_distinct(names)) > 1, "unclassified").otherwise(F.get(names, F.lit(0)))
    negated = F.exists(F.concat(before, F.array(p["opening"])), lambda w: _among(w, LEADS))
    short = (F.size(after) == 0) | ((F.get(after, F.lit(0)) == "for") & (F.size(after) <= 8)) | (p["colon"] & (F.size(after) <= 12))
    told = F.array_join(F.slice(words, 2, 4), " ")
    about = p["colon"] & _among(F.get(words, F.lit(0)), PEOPLE)
    starts = lambda phrases: reduce(lambda a, b: a | b, (F.startswith(told, F.lit(x)) for x in phrases))
    one = (at >= 0) & ~negated
    out = F.exists(words, lambda w: F.startswith(w, F.lit("exclusion")) | F.startswith(w, F.lit("noninclusion")))
    return [
        # a line of its own: the list's name behind at most one word, and little after it
        (one & ~p["marked"] & (F.size(before) <= 1) & (p["opening"] != "criteria") & short, kind),
        # behind a mark only with known qualifiers, and plainly the end of the line
        (one & p["marked"] & (F.size(after) == 0) & F.forall(before, lambda w: _among(w, QUALIFIERS)) & (p["criteria"] | p["colon"]), kind),
        (about & starts(KEPT_OUT), F.lit("exclusion")),
        (about & starts(LET_IN), F.lit("inclusion")),
        # what may head exclusions but doesn't plainly: what follows belongs to no list for sure
        (one & out & p["criteria"] & ~p["marked"] & ((F.size(before) <= 1) | (F.size(after) == 0) | (p["opening"] == "criteria")), F.lit("unclassified")),
    ]


def line_kind(line: Column) -> Column:
    """The kind of section that a heading line opens; NULL for any other line."""
    decided = _let(_parts(line), lambda p: F.coalesce(*(F.when(rule, kind) for rule, kind in _rules(p))))
    return F.when(line.rlike(_HINT) & (F.length(F.trim(line)) <= LONGEST), decided)


def laid_out(text: Column) -> Column:
    """The text with every heading on a line of its own: blanks around those within a line become line feeds, no word changes."""
    # a list's name that a sentence's end precedes, "criteria" follows and a colon closes
    apart = F.regexp_replace(text, r"(?i)(?<=[.;:：)])[ \t]+(?=[* ]*(?:non-?)?(?:in|ex)clusions? criteria[^.:：\n]{0,60}[:：])", "\n")

    def opened(line: Column) -> Column:
        head = F.regexp_extract(line, r"^[^:：]*[:：]\**", 0)
        rest = F.ltrim(F.substring(line, F.length(head) + 1, F.length(line)))
        inside = (F.length(head) > 0) & F.startswith(F.substring(line, F.length(head) + 1, F.lit(1)), F.lit(" ")) & (F.length(rest) > 0)
        return F.when(inside & line_kind(head).isNotNull(), F.concat(head, F.lit("\n"), rest)).otherwise(line)

    return F.array_join(F.transform(F.split(apart, "\n"), opened), "\n")


def split_sections(text: Column) -> Column:
    """array<struct<kind, heading, items>>: items are the lines that follow, verbatim, up to the next heading.

    Lines before the first heading, all lines of a text without one, and those after a line that may be a heading of
    exclusions but isn't plainly one, are ``unclassified``. Nothing is lost: headings and items in order are the text's lines.
    Use ``laid_out`` first where headings may stand within a line.
    """
    start = F.array(F.struct(F.lit("unclassified").alias("kind"), F.lit(None).cast("string").alias("heading"), F.array().cast("array<string>").alias("items")))

    def step(done: Column, line: Column) -> Column:
        kind, last = line_kind(line), F.element_at(done, -1)
        opened = F.concat(done, F.array(F.struct(kind.alias("kind"), line.alias("heading"), F.array().cast("array<string>").alias("items"))))
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["kind"].alias("kind"), last["heading"].alias("heading"), F.concat(last["items"], F.array(line)).alias("items"))))
        return F.when(kind.isNotNull(), opened).otherwise(longer)

    sections = F.aggregate(F.split(text, "\n"), start, step)
    return F.filter(sections, lambda s: s["heading"].isNotNull() | (F.size(s["items"]) > 0))


def section_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """The corpus form: one row per line with its section's number, kind, and whether it is a heading or a bullet.

    A running count of headings numbers the sections, so a long text costs no more per line than a short one.
    """
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("opens", line_kind(F.col("line")))
    over = Window.partitionBy(key).orderBy("pos")
    return lines.select(
        key, "pos", "line", F.count("opens").over(over).alias("section"), F.coalesce(F.last("opens", ignorenulls=True).over(over), F.lit("unclassified")).alias("kind"),
        F.col("opens").isNotNull().alias("is_heading"), F.col("line").rlike(BULLET).alias("is_bullet"),
    )


def rebuilt(sections: Column) -> Column:
    """The text again, for the check that nothing is lost."""
    return F.array_join(F.flatten(F.transform(sections, lambda s: F.concat(F.array_compact(F.array(s["heading"])), s["items"]))), "\n")
