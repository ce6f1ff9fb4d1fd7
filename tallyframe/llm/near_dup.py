"""Near-duplicate documents: banded MinHash candidates, verified by odd sketches and confirmed on whole shingle sets.

1. Each text becomes its set of distinct 5-word shingles, SAMPLES MinHash values, BANDS band keys of them, and an odd
   sketch: each sample toggles one of BITS bits, so the population count of two sketches' XOR tells how many samples
   differ, most precisely when few do. Documents with the same set are one node from here on.
2. Nodes that share a band key form a bucket. Each node is compared with the least node of its buckets; the pair whose
   sketches differ least is confirmed on the sets. Components of these links settle large groups of copies.
3. What could still join two components are pairs of a bucket in different components. In small buckets the pairs are
   joined; large buckets are cut into blocks of nodes, and pairs of blocks are compared by sketch in one task each,
   leaving out the pairs within the bucket's largest component. A second odd sketch, of the whole set in PARITY bits,
   differs in at most as many bits as the sets in shingles, so it rules pairs out without loss. The rest is confirmed.
4. Components of all confirmed links give each document the least doc_id it reaches.

Keys that many rows share (the key of a set with many copies, the band key of a large bucket, a hub on either side of a pair) are
counted and dealt to several tasks (``join_keyed``, ``_both_sides``); rows without a set take no part in joins.

At similarity 0.75 a pair shares no band with probability (1 - 0.75**4)**32 = 5e-6, and sketches rule it out (estimate
below LOOSE) with about the same; a link lost that way matters only if no chain of others joins the two.

Defined results: a text of fewer than 5 words is one shingle; a null or blank text has the empty set and links with
nothing, as has a row with null doc_id; rows that share a doc_id are one node; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .base import cut, dealt_join, fresh_name, heavy_keys, join_keyed, map_rows
from .components import connected_components

WORDS = 5
PERCENT = 75
SAMPLES = 128
BANDS = 32
BITS = 1024
PARITY = 4096
#: Pairs of a lower estimated similarity are not confirmed; five standard deviations below 0.75.
LOOSE = 0.55
#: Nodes a bucket may have for its pairs to be joined; larger buckets go block by block.
SMALL = 64
BLOCK = 512

_RANDOM = np.random.default_rng(20240501)
_A = _RANDOM.integers(0, 1 << 32, SAMPLES, np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, SAMPLES, np.uint64).astype(np.uint32)
_BAND = _RANDOM.integers(0, 1 << 63, (SAMPLES // BANDS, BANDS), np.uint64) | np.uint64(1)
_BIT = _RANDOM.integers(0, 1 << 63, SAMPLES, np.uint64) | np.uint64(1)
_PLACE = _RANDOM.integers(0, 1 << 63, WORDS, np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Most bits that the sketches of a pair may differ in, from the expected odd counts at LOOSE.
MOST_BITS = int(BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - LOOSE) / BITS)))

FEATURES = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("n_shingles", LongType()),
        StructField("set_key", BinaryType()),
        StructField("bands", ArrayType(LongType())),
        StructField("sketch", ArrayType(LongType())),
    ]
)
SETS = StructType([StructField("doc_id", LongType()), StructField("shingles", ArrayType(LongType())), StructField("parity", ArrayType(LongType()))])


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and just the six ASCII blanks
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1) if len(h) else 0
    x = np.zeros(n, np.uint64)
    for i in range(min(WORDS, len(h))):
        x += h[i : i + n] * _PLACE[i]
    x = (x ^ (x >> np.uint64(31)) ^ np.uint64(min(WORDS, len(h)))) * _MIX
    return np.unique(x ^ (x >> np.uint64(29)))


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketch of a set that isn't empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, (x[at : at + 512] * _A + _B).min(axis=0), out=least)
    wide = least.astype(np.uint64)
    keys = ((wide.reshape(SAMPLES // BANDS, BANDS) + np.uint64(1)) * _BAND).sum(axis=0, dtype=np.uint64)
    keys = (keys ^ (keys >> np.uint64(32)) ^ np.arange(BANDS, dtype=np.uint64)) * _MIX
    mixed = (wide + np.uint64(1)) * _BIT
    bits = ((mixed ^ (mixed >> np.uint64(33))) * _MIX) >> np.uint64(64 - BITS.bit_length() + 1)
    sketch = np.packbits((np.bincount(bits.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)
    return keys.view(np.int64), sketch


def whole_parity(shingles: np.ndarray) -> np.ndarray:
    """Odd sketch of the whole set."""
    place = ((shingles * _MIX) >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=PARITY) & 1).astype(np.uint8)).view(np.int64)


def features(docs: DataFrame) -> DataFrame:
    def run(doc_ids: pa.Array, texts: pa.Array) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": doc_ids, "n_shingles": [], "set_key": [], "bands": [], "sketch": []}
        for text in texts:
            shingles = shingle_set(text.as_py())
            keys, sketch = signature(shingles) if len(shingles) else (None, None)
            out["n_shingles"].append(len(shingles))
            out["set_key"].append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
            out["bands"].append(keys)
            out["sketch"].append(sketch)
        return out

    return map_rows(docs, ["doc_id", "text"], run, FEATURES)


def shingle_sets(docs: DataFrame) -> DataFrame:
    def run(doc_ids: pa.Array, texts: pa.Array) -> dict[str, list]:
        sets = [shingle_set(t.as_py()) for t in texts]
        return {"doc_id": doc_ids, "shingles": [s.view(np.int64) for s in sets], "parity": [whole_parity(s) for s in sets]}

    return map_rows(docs, ["doc_id", "text"], run, SETS)


def _differing_bits(a: str, b: str) -> Column:
    parts = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64)]
    return sum(parts[1:], parts[0])


def _both_sides(pairs: DataFrame, table: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Pairs (a, b), a written table, with columns of ``table`` (``node``, and those named) for both, by ``_a`` and ``_b`` behind their names.

    A hub of many pairs is dealt to several tasks on either side; both are counted on the pairs alone.
    """
    for end in "ab":
        side = table.select(F.col("node").alias(end), *(c.alias(f"{name}_{end}") for name, c in columns.items()))
        joined = dealt_join(pairs if end == "a" else joined, side, end, heavy_keys(pairs, end), ["a", "b"])
    return joined


def _with_sketches(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a written table, that the sketches can't rule out, with the number of bits they differ in."""
    joined = _both_sides(pairs, nodes, {"sketch": F.col("sketch")})
    return joined.select("a", "b", _differing_bits("sketch_a", "sketch_b").alias("bits")).where(F.col("bits") <= MOST_BITS)


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs, a written table, that the whole sets' parities allow: similarity p means that sets of s shingles together differ in s(1-p)/(1+p)."""
    joined = _both_sides(pairs, sets.withColumnRenamed("doc_id", "node"), {"n": F.size("shingles"), "parity": F.col("parity")})
    bits = F.aggregate(F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return joined.where((100 + percent) * bits <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs, a written table, whose whole sets are similar enough, as edges (u, v)."""
    n_a, n_b = F.size("set_a"), F.size("set_b")
    joined = _both_sides(pairs, sets.withColumnRenamed("doc_id", "node"), {"set": F.col("shingles")})
    near = joined.where(100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b))
    both = near.select("a", "b", (n_a + n_b).alias("n"), F.size(F.array_intersect("set_a", "set_b")).alias("i"))
    return both.where(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    named = labels.select(F.col("node"), F.col("label"))
    return rows.join(named, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _block_pairs(rows: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs across components in large buckets: rows (band, node, label) to distinct pairs (a, b)."""
    by_label = rows.groupBy("band", "label").agg(F.count("*").alias("n"))
    giant = by_label.groupBy("band").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    giant = giant.select("band", F.col("top.label").alias("giant"), blocks(F.col("top.n")).alias("n_giant"), blocks(F.col("all") - F.col("top.n")).alias("n_rest"))
    whole = sets.select(F.col("doc_id").alias("node"), F.size("shingles").alias("size"), "parity")
    row = join_keyed(rows, cut(giant, "large-bands"), "band").join(nodes.select("node", "sketch"), "node").join(whole, "node")
    inside = F.col("label") == F.col("giant")
    own = F.pmod(F.xxhash64("node"), F.when(inside, F.col("n_giant")).otherwise(F.col("n_rest"))).cast("int")
    row = row.withColumn("inside", inside).withColumn("own", own)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    across = F.transform(upto(F.when(F.col("inside"), F.col("n_rest")).otherwise(F.col("n_giant"))), lambda o: F.struct(F.lit(0).alias("kind"), F.when(F.col("inside"), F.col("own")).otherwise(o).alias("i"), F.when(F.col("inside"), o).otherwise(F.col("own")).alias("j")))
    among = F.transform(upto(F.col("n_rest")), lambda o: F.struct(F.lit(1).alias("kind"), F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    units = row.withColumn("unit", F.explode(F.when(F.col("inside"), across).otherwise(F.concat(across, among))))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        node, label = rows["node"].to_numpy(), rows["label"].to_numpy()
        sketch = np.stack(rows["sketch"].to_numpy()).view(np.uint64)
        parity, size = np.stack(rows["parity"].to_numpy()).view(np.uint64), rows["size"].to_numpy()
        inside = rows["inside"].to_numpy()
        left = np.flatnonzero(inside) if key[1] == 0 else np.arange(len(node))
        right = np.flatnonzero(~inside) if key[1] == 0 else np.arange(len(node))
        found = []
        for k in left:
            bits = np.bitwise_count(sketch[right] ^ sketch[k]).sum(axis=1)
            hit = right[(bits <= MOST_BITS) & (label[right] != label[k])]
            most = (100 - percent) * (size[hit].astype(np.int64) + size[k])
            hit = hit[(100 + percent) * np.bitwise_count(parity[hit] ^ parity[k]).sum(axis=1, dtype=np.int64) <= most]
            found += [(min(node[k], node[h]), max(node[k], node[h])) for h in hit]
        return pd.DataFrame(sorted(set(found)), columns=["a", "b"], dtype="int64")

    columns = units.select("band", F.col("unit.kind").alias("kind"), F.col("unit.i").alias("i"), F.col("unit.j").alias("j"), "node", "label", "sketch", "inside", "size", "parity")
    return columns.groupBy("band", "kind", "i", "j").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    found = cut(features(docs), "shingle-features")
    usable = found.where(F.col("n_shingles").cast("boolean") & F.col("doc_id").isNotNull())
    # of each set the row of least doc_id, combined before the shuffle however many copies it has
    first = usable.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.min_by(F.struct("bands", "sketch"), "doc_id").alias("own"))
    first = cut(first.select("set_key", "node", "own.bands", "own.sketch"), "nodes")
    nodes = first.select("node", "bands", "sketch")

    keys = cut(nodes.select("node", F.explode("bands").alias("band")), "band-keys")
    buckets = keys.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1")
    shared = cut(join_keyed(keys, cut(buckets, "buckets"), "band"), "shared-bands")

    wanted = shared.select(F.col("node").alias("doc_id")).distinct()
    sets = cut(shingle_sets(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")).dropDuplicates(["doc_id", "shingles"]), "shingle-sets")

    star = shared.where("node <> pivot").select(F.col("node").alias("b"), F.col("pivot").alias("a")).distinct()
    star = _with_sketches(cut(star, "stars"), nodes).groupBy("b").agg(F.min(F.struct("bits", "a")).alias("best"))
    star = cut(star.select("b", F.col("best.a").alias("a")), "stars")
    links = cut(_confirmed(star, sets, percent), "links")
    labels = cut(connected_components(links), "labels")

    rows = cut(_labelled(shared.select("band", "n", "node"), labels), "labelled-bands")
    mixed = rows.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band")
    rows = cut(join_keyed(rows, cut(mixed, "mixed-bands"), "band"), "open-bands")
    few = rows.where(F.col("n") <= SMALL).select("band", "node", "label")
    left = few.select("band", F.col("node").alias("a"), F.col("label").alias("label_a"))
    right = few.select("band", F.col("node").alias("b"), F.col("label").alias("label_b"))
    pairs = left.join(right, "band").where("a < b and label_a <> label_b").select("a", "b").distinct()
    few = _possible(cut(_with_sketches(cut(pairs, "open-pairs"), nodes).select("a", "b"), "open-pairs"), sets, percent)
    more = cut(few.unionByName(_block_pairs(rows.where(F.col("n") > SMALL), nodes, sets, percent)), "open-pairs")
    labels = cut(connected_components(links.unionByName(_confirmed(more, sets, percent))), "labels")

    named = _labelled(first.select("set_key", "node"), labels).groupBy("set_key").agg(F.min("label").alias("component_id"))
    rows = found.select("doc_id", "n_shingles", "set_key")
    known = join_keyed(rows.where("set_key IS NOT NULL"), cut(named, "named-sets"), "set_key", "left")
    # a row without a set or without a doc_id is linked with nothing
    known = known.unionByName(rows.where("set_key IS NULL").withColumn("component_id", F.col("doc_id")))
    # rows that share a doc_id but not a text are one node, so the least of their components holds
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return known.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _number() -> Column:
    """doc_id, or for a row without one a number above 2**62 that its text gives."""
    return F.coalesce(F.col("doc_id"), F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62)))


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group, the one of least doc_id, with all its columns.

    A row with null doc_id takes part under a number that its text's hash gives, above 2**62, so copies of it go too. Of rows that
    share a doc_id (or have none) and a text one stays, blank texts included. Rows of one doc_id with different texts are one
    document and stay or go together.
    """
    number, copied = (fresh_name(c, docs.columns) for c in ("number", "copied"))
    named = docs.select(_number().alias("doc_id"), "text")
    lost = near_duplicates(named, percent).where(~F.col("kept")).select(F.col("doc_id").alias(number)).distinct()
    kept = docs.join(cut(lost, "duplicates"), _number() == F.col(number), "left_anti")
    # rows that are there more than once are rare, so only they are dealt by their key; one row of each is combined before the shuffle
    twice = docs.groupBy(_number().alias(number), F.xxhash64("text").alias(copied)).agg(F.count("*").alias("n")).where("n > 1").select(number).distinct()
    twice = cut(twice, "repeated-rows")
    if twice.isEmpty():
        return kept
    one = kept.join(twice, _number() == F.col(number), "left_semi").withColumn(number, _number()).dropDuplicates([number, "text"]).drop(number)
    return kept.join(twice, _number() == F.col(number), "left_anti").unionByName(one)


#: All pairs that share a shingle, for DuckDB on small tables.
COMPONENTS_ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT both_ways.b, r.root FROM r JOIN both_ways ON both_ways.a = r.doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, doc_id) AS component_id, coalesce(c.component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""
