"""The k best matches against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.plans.similarity import Factor, build_related, build_top_matches, overlap

FACTORS = (
    Factor("condition", 0.3, holds=overlap("groups")), Factor("phase", 0.2, ("phase",)), Factor("geography", 0.15, holds=overlap("states")), Factor("design", 0.1, ("kind", "purpose")),
    Factor("age", 0.1, holds=lambda a, b: a("low") <= b("high")), Factor("band", 0.1, ("band",)), Factor("sex", 0.05, ("sex",)),
)
SCHEMA = "id int, groups array<string>, phase string, states array<string>, kind string, purpose string, low int, high int, band string, sex string"


def rows(n, seed, few):
    r = random.Random(seed)
    some = lambda s, m: sorted(r.sample(s, r.randrange(m)))
    own = lambda s: r.choice([None, *s])
    made = [(some("vwxyz", 3), own("12"), some("abcd", 3), own("kl"), own("p"), own([10, 20]), own([15, 30]), own("sml"), own("FM")) for _ in range(few)]
    return [(i, *r.choice(made)) for i in range(n)]


def plain(data, k, most):
    held = {t: sum(t in d[1] for d in data) for t in "vwxyz"}
    eq = lambda a, b, *at: all(a[i] is not None and a[i] == b[i] for i in at)
    out = set()
    for a in data:
        found = []
        for b in data:
            if a[0] == b[0] or not any(t in b[1] and held[t] < most for t in a[1]):
                continue
            flags = [bool(set(a[1]) & set(b[1])), eq(a, b, 2), bool(set(a[3]) & set(b[3])), eq(a, b, 4, 5), a[6] is not None and b[7] is not None and a[6] <= b[7], eq(a, b, 8), eq(a, b, 9)]
            found.append((-round(sum(f.weight for f, x in zip(FACTORS, flags, strict=True) if x), 4), b[0], tuple(map(int, flags))))
        out |= {(a[0], b, -s, n + 1, *flags, "; ".join(f.name for f, x in zip(FACTORS, flags, strict=True) if x)) for n, (s, b, flags) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("n,few,k,most", [(150, 25, 4, 2000), (90, 90, 25, 30)])
def test_top_matches_against_all_pairs(spark, n, few, k, most):
    data, stats = rows(n, n, few), {}
    got = build_top_matches(spark.createDataFrame(data, SCHEMA).repartition(3), "id", "groups", FACTORS, k, most, stats)
    assert got.columns == ["id", "match", "score", "rank", *(f.name for f in FACTORS), "shared"]
    assert {tuple(x) for x in got.collect()} == plain(data, k, most)
    assert stats["classes"] <= few
    if few < n:
        assert stats["pairs"] < n * n / 20


def test_pairs_that_cannot_count_are_not_made(spark):
    # one token, many phases: each record finds its k matches within its own phase
    data = [(i, ["t"], str(i % 40), ["a"], "k", "p", 1, 2, str(i // 40 % 8), "F" if i % 3 else "M") for i in range(1200)]
    stats = {}
    got = build_top_matches(spark.createDataFrame(data, SCHEMA), "id", "groups", FACTORS, 5, 2000, stats)
    assert got.count() == 6000 and got.agg(F.min("score")).first()[0] >= 0.9
    assert stats["pairs"] < stats["classes"] ** 2 / 10


def test_top_matches_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert build_top_matches(empty, "id", "groups", FACTORS).collect() == []
    alone = spark.createDataFrame([(1, [], "1", [], None, None, None, None, None, None), (2, None, "1", [], None, None, None, None, None, None)], SCHEMA)
    assert build_top_matches(alone, "id", "groups", FACTORS).collect() == []


def test_related_records_of_several_targets(spark):
    data = rows(60, 5, 40)
    r = random.Random(1)
    groups = [(i, r.choice([None, "g1", "g2", "g3"])) for i in range(60) for _ in range(2)]
    terms = [(i, r.choice([None, "t1", "t2", "t3"]), r.random() < 0.7) for i in range(60) for _ in range(2)]
    make = spark.createDataFrame
    got = build_related(make(data, SCHEMA), make([(3,), (7,), (7,), (99,)], "id int"), "id", make(groups, "id int, group string"), make(terms, "id int, term string, is_ancestor boolean"), "phase", FACTORS, 5, 12, 0.2)
    eq = lambda a, b, *at: all(a[i] is not None and a[i] == b[i] for i in at)
    want = set()
    for target in (3, 7):
        a, found = data[target], []
        for b in data:
            shared = {g for i, g in groups if i == target and g} & {g for i, g in groups if i == b[0]}
            depth = max((2 - (u or v) for i, t, u in terms if i == target and t for j, s, v in terms if j == b[0] and s == t and not (u and v)), default=0)
            if b[0] != target and (shared or depth):
                found.append((not eq(a, b, 2), not shared, -depth, b[0], bool(shared)))
        scored = []
        for *_, k, same in sorted(found)[:12]:
            b = data[k]
            flags = [same, eq(a, b, 2), bool(set(a[3]) & set(b[3])), eq(a, b, 4, 5), a[6] is not None and b[7] is not None and a[6] <= b[7], eq(a, b, 8), eq(a, b, 9)]
            score = round(sum(f.weight for f, x in zip(FACTORS, flags, strict=True) if x), 4)
            if score >= 0.2:
                scored.append((-score, k, tuple(map(int, flags))))
        want |= {(target, k, -s, n + 1, *flags) for n, (s, k, flags) in enumerate(sorted(scored)[:5])}
    assert {tuple(x)[:-1] for x in got.collect()} == want and want


def test_related_records_are_not_all_paired(spark):
    """Few groups and terms for many records: targets x records would be 1,000,000 pairs."""
    n, r = 2000, random.Random(8)
    data = [(i, [f"g{i % 2}"], r.choice([None, "P1", "P2"]), ["s"], "k", "p", 1, 2, "b", "F") for i in range(n)]
    groups = [(i, f"g{i % 2}") for i in range(n)]
    terms = [(i, f"t{r.randrange(3)}", r.choice([None, True, False])) for i in range(n) for _ in range(2)]
    make = spark.createDataFrame
    targets = list(range(0, n, 4))
    features, listed = make(data, SCHEMA), make(terms, "id int, term string, is_ancestor boolean")
    related = build_related(features, make([(i,) for i in targets], "id int"), "id", make(groups, "id int, group string"), listed, "phase", FACTORS, 3, 20)
    got = {}
    for x in related.collect():
        got.setdefault(x["target"], []).append((x["id"], x["condition"]))
    of = {}
    for i, t, up in terms:
        of.setdefault(i, set()).add((t, up))
    for target in targets[:40]:
        found = []
        for b in range(n):
            # an unknown kind of term joins direct ones only, as if direct itself
            depth = max((1 if u or v else 2 for t, u in of[target] for s, v in of[b] if s == t and (u is False or v is False)), default=0)
            shared = b % 2 == target % 2
            if b != target and (shared or depth):
                phase = data[target][2]
                found.append((phase is None or phase != data[b][2], not shared, -depth, b))
        best = sorted(found)[:20]
        scores = sorted((-round(0.3 * (not other) + 0.2 * (not apart) + 0.5, 4), b, int(not other)) for apart, other, _, b in best)
        assert got[target] == [(b, c) for _, b, c in scores[:3]], target
    plan = related._jdf.queryExecution().toString()
    assert plan.count("Generate explode(_keys") >= 6 and "WindowGroupLimit" in plan
