"""Operators on groups, pairs and tables, on the hard cases and against plain versions."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from helpers import frame, hard_rows, prose
from pyspark.sql import functions as F

from tallyframe.llm import base, components, kmeans, maxscore, mixing, near_dup, warc_fixity


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_components(rows):
    """Least doc_id reachable over links of similarity 0.75 and more."""
    sets, top = [(i, shingles(t)) for i, t, _ in rows if i is not None], {i: i for i, _, _ in rows if i is not None}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in top}


def test_near_duplicates_against_all_pairs(spark):
    base = prose(200, 50).split(" ")
    rows = [*hard_rows(), (30, prose(60, 3), "q"), (31, "", "q")]
    for k in range(90):  # near copies of one text, more than a small bucket holds, and pairs of medium similarity
        words = list(base)
        for p in range(k % 9):
            words[(17 * p + 31 * k) % len(words)] = f"edit{k}x{p}"
        rows.append((200 + k, " ".join(words), "h"))
    rows += [(400 + k, prose(40, k) + " " + prose(60, 99), "p") for k in range(30)]  # a shared passage
    out = near_dup.near_duplicates(frame(spark, rows)).collect()
    want = plain_components(rows)
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _, _ in rows)
    for r in out:
        assert r["component_id"] == want.get(r["doc_id"]), r
        if r["doc_id"] is not None:
            assert r["n_shingles"] in {len(shingles(t)) for i, t, _ in rows if i == r["doc_id"]}
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    kept = near_dup.keep_first(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    rows_kept = kept.collect()
    assert {r["doc_id"] for r in rows_kept} - {None} == set(want.values())
    assert [r["doc_id"] for r in rows_kept].count(7) == 1
    assert near_dup.near_duplicates(frame(spark, rows).where("false")).collect() == []
    clash = frame(spark, rows[:4]).selectExpr("*", "1 AS gone_id", "2 AS set_key", "3 AS node", "4 AS part")
    kept = near_dup.keep_first(clash)
    assert kept.columns == clash.columns and {r["doc_id"] for r in kept.collect()} == {1, 3, 4}


def test_one_row_of_each_group_stays(spark):
    text, other = prose(60, 31), prose(60, 32)
    near = text.replace(text.split()[30], "edited", 1)
    rows = [(1, text, "a"), (1, text, "b"), (1, text, "a"), (None, text, "a"), (None, text, "c"), (None, near, "a"), (None, other, "a"), (None, other, "a"), (2, near, "x"),
            (3, None, "a"), (3, None, "a"), (None, None, "a"), (None, "", "a"), (4, prose(60, 33), "a"), (4, prose(60, 34), "a")]
    kept = near_dup.keep_first(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter({(1, text), (None, other), (3, None), (None, None), (None, ""), (4, rows[-2][1]), (4, rows[-1][1])})


def test_joins_deal_heavy_keys_to_several_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(base, "HEAVY", 10)
    monkeypatch.setattr(base, "MOST_HEAVY", 2)
    data = [(k, i, "x") for k, n in ((1, 500), (2, 45), (3, 12), (4, 3), (None, 30)) for i in range(n)]
    spark.createDataFrame(data, "k long, i long, part string").write.parquet(f"{tmp_path}/rows")
    rows, table = spark.read.parquet(f"{tmp_path}/rows"), spark.createDataFrame([(1, "a"), (2, "b"), (4, "d"), (9, "z")], "k long, parts string")
    for how in ("inner", "left"):
        got = base.join_keyed(rows, table, "k", how)
        assert Counter(got.select("k", "i", "part", "parts").collect()) == Counter(rows.join(table, "k", how).select("k", "i", "part", "parts").collect())


def test_a_hub_of_the_greatest_id_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(base, "HEAVY", 5)
    base_words = prose(120, 70).split(" ")
    rows = [(900, " ".join(base_words), "h")]  # near all of these, which aren't near each other
    for k in range(24):
        words = list(base_words)
        words[5 * (k % 20) + 2] = f"own{k}"
        words[-1 - k // 20] = f"end{k}"
        rows.append((k, " ".join(words), "h"))
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got == plain_components(rows)
    pairs = base.cut(spark.createDataFrame([(k, 900) for k in range(40)] + [(1, k) for k in range(2, 20)], "a long, b long"), "pairs")
    nodes = spark.createDataFrame([(k, k * 7) for k in [*range(40), 900]], "node long, x long")
    assert Counter(map(tuple, near_dup._both_sides(pairs, nodes, {"x": F.col("x")}).select("a", "b", "x_a", "x_b").collect())) == Counter((a, b, 7 * a, 7 * b) for a, b in pairs.collect())
    assert {r["b"]: r["parts"] for r in base.heavy_keys(pairs, "b").collect()} == {900: 8}


def test_large_buckets_go_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 3)
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    base, rows = prose(60, 5).split(" "), []
    for k in range(40):
        words = list(base)
        for p in range(1 + k % 6):
            words[(13 * p + 7 * k) % len(words)] = f"e{k}x{p}"
        rows.append((k, " ".join(words), "h"))
    out = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert out == plain_components(rows)


def test_parity_never_rules_out_a_link():
    r = np.random.default_rng(1)
    for _ in range(50):
        n = int(r.integers(5, 3000))
        a = np.unique(r.integers(0, 1 << 63, n, np.uint64))
        b = np.unique(np.concatenate([a[: int(n * 0.9)], r.integers(0, 1 << 63, n // 20, np.uint64)]))
        both = len(np.intersect1d(a, b))
        bits = int(np.bitwise_count((near_dup.whole_parity(a) ^ near_dup.whole_parity(b)).view(np.uint64)).sum())
        assert bits <= len(a) + len(b) - 2 * both


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5000, 5000)], "u long, v long")
    got = {r["node"]: r["label"] for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_mixing_meets_targets(spark):
    rows = [*hard_rows(), *((100 + i, prose(20 + i % 50, i), s) for i in range(400) for s in [("a", "b", "c", None, "e")[min(4, i % 7)]])]
    docs = frame(spark, rows)
    out = mixing.mixture(docs).collect()
    again = mixing.mixture(docs.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"])
    assert Counter(map(key, out)) == Counter(map(key, again)) and len(out) == len(rows)
    sizes, aims, taken, largest = Counter(), {}, Counter(), Counter()
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        aims[r["source"]] = (r["source_size"], r["target"])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    total = 1.5 * sum(sizes.values())
    left, open_ = total, {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    want = {}
    while True:  # share by weight, stop those above, share again
        price = left / sum(open_.values())
        full = [s for s, w in open_.items() if price * w > 2 * sizes[s]]
        if not full:
            want |= {s: price * w for s, w in open_.items()}
            break
        for s in full:
            want[s] = 2 * sizes[s]
            left -= 2 * sizes[s]
            del open_[s]
    for s in sizes:
        assert aims[s][0] == sizes[s] and abs(aims[s][1] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= largest[s]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want_copies = Counter()
    for r in out:
        want_copies[r["doc_id"]] += r["times"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +want_copies
    clash = docs.selectExpr("*", "1 AS times", "2 AS threshold", "3 AS takes_last", "4 AS mix_s", "5 AS mix", "6 AS s", "7 AS hash")
    assert mixing.mix(clash).columns == clash.columns and Counter(r["doc_id"] for r in mixing.mix(clash).collect()) == +want_copies
    assert mixing.mixture(docs.where("false")).collect() == [] and mixing.mix(docs.where("false")).collect() == []


def test_blank_documents_are_never_taken_beyond_the_limit(spark):
    rows = [(k, "" if k % 2 else None, "b") for k in range(19)] + [(20, "one two three", "b")] + [(100 + k, prose(200, k), "a") for k in range(20)]
    taken = mixing.mixture(frame(spark, rows)).where("source = 'b'").collect()
    assert {r["times"] for r in taken} == {2} and {r["target"] for r in taken} == {6.0}
    assert set(Counter(r["doc_id"] for r in mixing.mix(frame(spark, rows)).where("source = 'b'").collect()).values()) == {2}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")


@pytest.mark.parametrize("growth", [2, 16])
def test_maxscore_against_all_scores(spark, monkeypatch, growth):
    monkeypatch.setattr(maxscore, "BLOCK", 16)
    monkeypatch.setattr(maxscore, "VECTORS", 64)
    monkeypatch.setattr(maxscore, "QUERIES", 2)
    monkeypatch.setattr(maxscore, "GROWTH", growth)
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(0, 0.2, 8).astype(np.float32)], "x") for i in range(500)]
    rows += [(600 + i, rows[i % 5][1], "x") for i in range(30)]  # ties
    rows += [(700, None, "x"), (701, [], "x"), (702, [None] * 8, "x"), (703, [float("nan")] * 8, "x"), (704, [float("inf")] * 8, "x"), (None, [1.0] * 8, "x"), (705, [0.5, 0.5], "x"), (800, [0.0] * 8, "x")]
    made = maxscore.integer_vectors(vectors(spark, rows))
    got = maxscore.top_k(made, made.where("vec_id % 100 = 0")).collect()
    fine = [(i, np.floor(1024 * np.array(list(v) + [0] * (8 - len(v)), float)).astype(int)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for q, a in fine:
        if q % 100 == 0:
            best = sorted((-int(a @ b), i) for i, b in fine if i != q)[:10]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want
    none = maxscore.integer_vectors(vectors(spark, rows).where("false"))
    assert maxscore.top_k(none, none).collect() == []


def test_maxscore_shards_with_a_bar_send_less(spark):
    r = np.random.default_rng(8)
    v = np.floor(1024 * r.normal(0, 0.2, (2000, 16))).astype(int)
    made = spark.createDataFrame([(i, i % 20, 0, x.tolist()) for i, x in enumerate(v)], "vec_id long, shard int, part int, v array<long>")
    bars = {q: sorted((int(v[i] @ v[q]) for i in range(2000) if i % 20 < 5 and i != q), reverse=True)[9] for q in range(0, 2000, 100)}
    asked = lambda bar: spark.createDataFrame([(q, s, 0, v[q].tolist(), str(b) if bar else None) for q, b in bars.items() for s in range(20)], "vec_id long, shard int, part int, v array<long>, bar string")
    every, few = (maxscore.scored_tiles(made, asked(bar), 16, 10).collect() for bar in (False, True))
    assert len(every) == 20 * 20 * 10 and len(few) < len(every) / 4 and min(x["score"] - bars[x["query_id"]] for x in few) == 0
    for q in bars:
        first = lambda rows: sorted((-x["score"], x["vec_id"]) for x in rows if x["query_id"] == q)[:10]  # noqa: B023, E731
        assert first(every) == first(few)


def test_maxscore_skips_most_vectors():
    r = np.random.default_rng(4)
    for n in (500, 8192):  # the bounds act in small tables too
        v = np.floor(1024 * r.normal(0, 0.1, (n, 32)) * np.array([8] * 2 + [0.2] * 30))
        order = np.argsort(-(v * v).sum(axis=1))
        stats = {}
        ids, score = maxscore.search_tile(order, v[order], -1, v[5], 10, stats)
        assert list(score) == sorted((v @ v[5]).tolist(), reverse=True)[:10]
        assert stats["products"] < 0.6 * v.size


PAGE = "page_id long, url string, html string"


def test_warc_audit_finds_exactly_the_damage(spark):
    far = (1 << 60) + 16
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(0, 3000, 2)] + [(10, "http://h/10", "again"), (-1, "u", "minus"), (far, "u", "far"), (far - 1, "u", "near"), (7001, None, "x" * 300_000)]
    bad = [r for r in rows if r[0] not in (64, 2998)]
    bad = [(i, u, "<p>rot</p>" if i in (0, 1026, -1, far) else h) for i, u, h in bad] + [(5000, "u", "new"), (32, "u", "second")]
    records = lambda d: warc_fixity.warc_records(spark.createDataFrame([(*r, "x", 1) for r in d], f"{PAGE}, digest string, start int"))
    got = {r["key"]: r for r in warc_fixity.audit(records(rows), records(bad)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {64: "missing", 2998: "missing", 0: "altered", 1026: "altered", -1: "altered", far: "altered", 5000: "extra", 32: "altered"}
    assert got[0]["offset"] == 0 and got[64]["offset"] > 0 and got[1026]["file"] == 1 and got[far]["file"] == far >> 10
    rows = [r for r in rows if 0 <= r[0] < 4000]
    assert warc_fixity.audit(records(rows), records(rows[::-1])).collect() == []
    empty = records(rows).where("false")
    assert warc_fixity.audit(empty, empty).collect() == []
    assert warc_fixity.audit(records(rows[:5]), empty).count() == 5
    many = [(-i, "u", f"{i}") for i in range(1, 600)]  # negative keys end in one root too
    assert {r["key"] for r in warc_fixity.audit(records(many), records(many[1:])).collect()} == {-1}


def test_warc_audit_locates_damage_among_records_without_a_key(spark):
    rows = [(None, f"u{i}", f"<p>{i}</p>") for i in range(300)] + [(None, "u7", "<p>7</p>"), (3, "u", "kept"), (None, None, None)]
    records = lambda d: warc_fixity.warc_records(spark.createDataFrame(d, PAGE))
    assert warc_fixity.audit(records(rows), records(rows[::-1])).collect() == []
    got = warc_fixity.audit(records(rows), records(rows[5:300] + rows[301:])).collect()
    assert Counter((r["key"], r["status"]) for r in got) == {(None, "missing"): 5, (None, "altered"): 1}


def test_warc_audit_finds_records_in_another_place(spark):
    rows = warc_fixity.warc_records(spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>") for i in range(2000)], PAGE)).collect()
    place, at = {}, Counter()
    for r in rows:
        place[r["key"]] = at[r["key"] >> 10]
        at[r["key"] >> 10] += r["length"]
    table = lambda of: spark.createDataFrame([(r["key"], r["digest"], r["length"], of[r["key"]]) for r in rows], "key long, digest string, length long, offset long")
    found = lambda of: {r["key"]: (r["status"], r["n_records"]) for r in warc_fixity.audit(table(place), table(of)).collect()}
    assert found(place) == {}
    # two records of one length change places; a hole opens before one record, and before a whole branch
    assert found(place | {101: place[102], 102: place[101]}) == {101: ("moved", 1), 102: ("moved", 1)}
    assert found(place | {k: v + 7 for k, v in place.items() if 1030 <= k}) == {1030: ("moved", 1)}
    assert found(place | {k: v + 7 for k, v in place.items() if 1040 <= k}) == {1040: ("moved", 16)}


def plain_clusters(rows, k=kmeans.K, rounds=kmeans.ROUNDS):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(max(-kmeans.MOST, min(kmeans.MOST, 256 * x))) for x in v]))
    hashes = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in hashes[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members = [[v for (_, v), (_, n) in zip(kept, [near(v) for _, v in kept], strict=True) if n == c] for c in range(len(centroids))]
        centroids = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(members, centroids, strict=True)]
    found = [(i, *near(v)) for i, v in kept] if centroids else []
    sums = Counter()
    for _, d, n in found:
        sums[n] += d
    long = lambda n: n if n < 1 << 63 else None
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, n, d, long(sums[n]), long(sum(sums.values())), text[n]) for i, d, n in found)


CLUSTERED = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def embedded(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, near double").repartition(3)


def test_clusters_against_plain_rounds(spark):
    r = np.random.default_rng(3)
    around = r.normal(0, 1, (9, 64))
    rows = [(i, np.float32(around[i % 9] + r.normal(0, 0.2 * (i % 3), 64)).tolist()) for i in range(200)]
    rows += [(300 + i, [0.25 * (i % 2)] * 64) for i in range(60)]  # copies and ties
    rows += [(7, rows[8][1]), (7, rows[7][1]), (None, rows[3][1]), (None, None), (900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65)]
    rows += [(904, [float("nan")] * 64), (905, [None, *[1.0] * 63]), (906, [float("inf"), *[0.0] * 63])]
    got = kmeans.cluster(embedded(spark, rows))
    assert got.columns == CLUSTERED
    assert Counter(tuple(x) for x in got.collect()) == plain_clusters(rows)
    few = rows[:5] + rows[-9:-6]
    assert Counter(tuple(x) for x in kmeans.cluster(embedded(spark, few)).collect()) == plain_clusters(few)
    for none in (rows[-3:], [(None, rows[0][1])]):
        assert kmeans.cluster(embedded(spark, none)).collect() == []
    assert kmeans.cluster(embedded(spark, rows[:1]).where("false")).columns == CLUSTERED


def test_clusters_of_very_long_vectors(spark):
    rows = [(i, [(-1.0) ** (i + j) * 10.0 ** (i % 7 * 6) for j in range(64)]) for i in range(50)]
    assert Counter(tuple(x) for x in kmeans.cluster(embedded(spark, rows, "double")).collect()) == plain_clusters(rows)


def test_the_bound_leaves_out_centroids_and_no_nearest():
    r = np.random.default_rng(4)
    spread = 2.0 ** -np.arange(64)
    for scale in (1, 1000):
        x = np.floor(scale * 256 * r.normal(0, 1, (3000, 64)) * spread).astype(np.int64)
        centroids = x[:40]
        mean = x.mean(axis=0)
        space = kmeans.Space(mean, np.linalg.eigh(np.cov(x.T))[1][:, ::-1])
        stats = {}
        cluster, distance = kmeans.nearest(x, space.of(x), centroids, space.of(centroids), stats)
        every = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
        assert stats["distances"] < 0.1 * every.size
