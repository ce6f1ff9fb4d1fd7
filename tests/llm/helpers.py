"""Small document tables with the cases that every operator must handle."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    words = [r.choice(WORDS) + r.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, n, 12))


def frame(spark, rows, **extra):
    """doc_id, text, lang, source, n_chars and columns whose names operators use themselves."""
    data = [(i, t, "en", s, len(t) if t is not None else None, "x", 7.0, True) for i, t, s in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, size boolean")


def hard_rows():
    """Null and empty texts, null ids and sources, a very long text, repeats and ties."""
    long = prose(30_000, 1)
    return [
        (1, prose(80, 2), "a"), (2, prose(80, 2), "b"), (3, None, "a"), (4, "", None), (5, " \n\t ", "b"), (None, prose(60, 3), None), (6, long, "a"),
        (7, prose(120, 4), "c"), (7, prose(120, 4), "c"), (8, "one two", "d"), (9, "mail a.b@c.example.org now", "a"), (10, "x" * 5000, "b"),
        (11, "ünïcödé straße 日本語 \x1c mixed blank <|endoftext|> it's", "c"), (12, "double  spaces\n\nand lines ", "a"),
    ]
