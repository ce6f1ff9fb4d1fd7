"""Exact top-k by inner product, with MaxScore bounds over sharded vectors.

Components are the terms: a query's terms are its non-zero components. Vectors are dense, so a term's postings are a column
of the shard, one value for every vector, and a block is a range of them. In each block
of a shard, a term adds between q*min and q*max. Terms whose upper bounds together can't
lift a vector to the query's k-th best score so far are non-essential: the essential terms are summed for the whole block,
and the others are probed, widest bound first, for those vectors only that can still reach it. Vectors stand in
decreasing length, so the threshold is high early; blocks grow from FIRST on, so that it is there after few vectors, at every
size. Each shard keeps k per query, and the shards' lists are merged.

Shards are searched in rounds, each of GROWTH times the shards so far. After a round a query's k-th best score is its bar, which the next
round's shards start from: they send only what reaches it, about GROWTH * k rows per query and round however many shards there are, and lose nothing.

Queries meet shards in tiles of QUERIES queries and VECTORS vectors, one task group each, so memory has a fixed bound.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor does a null
vec_id; a shorter vector counts as padded with zeros; rows that repeat a vec_id are candidates each, and none is one
for its own query; a query with fewer than k candidates gets all; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut

K = 10
SCALE = 1024
VECTORS, QUERIES = 16_384, 65_536
#: Shards of the first round; each later round takes all up to so many times the shards before it.
GROWTH = 16
#: Vectors of the first block, which is scored in full as there is no threshold yet, and of the last; each is twice the one before.
FIRST, BLOCK = 64, 2_048
#: Sums of products below this are exact in double precision.
EXACT = 2.0**53


def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and v, the floors of the scaled components, of the vectors that take part."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    kept = rows.where(F.col(key).isNotNull() & (F.size(x) > 0) & fine)
    return kept.select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(scale * c.cast("double"))).alias("v"))


def matrix(column: pd.Series, width: int) -> np.ndarray:
    if (column.map(len) == width).all():
        return np.stack(column.to_numpy()).astype(np.float64)
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def blocks_of(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Growing blocks of the vectors, each with the least and the greatest value of every component."""
    out, at, size = [], 0, FIRST
    while at < len(vectors):
        block = vectors[at : at + size]
        out.append((block, block.min(axis=0), block.max(axis=0)))
        at, size = at + size, min(2 * size, BLOCK)
    return out


def search_tile(
    ids: np.ndarray, vectors: np.ndarray, query_id: int, q: np.ndarray, k: int, stats: dict | None = None, blocks: list | None = None, least: float | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """vec_id and score of the tile's k best for one query: higher scores, then smaller vec_id. ``blocks``: of the vectors, for many queries.

    ``least``: a score that k other vectors reach, so lower ones are left out.
    """
    blocks = blocks_of(vectors) if blocks is None else blocks
    stats = {} if stats is None else stats
    terms = np.flatnonzero(q)
    best_id, best = np.empty(0, np.int64), np.empty(0, q.dtype)
    at = 0
    for block, lows, highs in blocks:
        own = ids[at : at + len(block)]
        at += len(block)
        ends = np.stack([lows[terms] * q[terms], highs[terms] * q[terms]])
        order = np.argsort(ends.max(axis=0) - ends.min(axis=0), kind="stable")  # narrow bounds first
        names, high = terms[order], ends.max(axis=0)[order]
        bar = least
        if len(best) >= k and (bar is None or best[k - 1] > bar):
            bar = best[k - 1]
        left = np.arange(len(own))
        if bar is None:
            score = block[:, names] @ q[names]
            stats["products"] = stats.get("products", 0) + block.shape[0] * len(names)
        else:
            # non-essential: a longest run of narrow terms that, added to the least that the others give, misses the bar
            rest = np.cumsum(high)
            low_rest = ends.min(axis=0)[order][::-1].cumsum()[::-1]
            alone = rest + np.concatenate([low_rest[1:], [low_rest.dtype.type(0)]])
            cut = int(np.searchsorted(alone >= bar, True)) if len(alone) else 0
            essential = names[cut:]
            score = block[:, essential] @ q[essential]
            stats["products"] = stats.get("products", 0) + block.shape[0] * len(essential)
            upto = cut
            while True:
                possible = score + (rest[upto - 1] if upto else 0) >= bar
                left, score = left[possible], score[possible]
                if not upto or not len(left):
                    break
                step = names[max(0, upto - 8) : upto]  # the widest of what is left
                score = score + block[np.ix_(left, step)] @ q[step]
                stats["products"] += len(left) * len(step)
                upto = max(0, upto - 8)
        other = own[left] != query_id
        all_id, every = np.concatenate([best_id, own[left][other]]), np.concatenate([best, score[other]])
        keep = np.lexsort((all_id, -every))[:k]
        best_id, best = all_id[keep], every[keep]
    return best_id, best


def scored_tiles(left: DataFrame, right: DataFrame, width: int, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each query in each shard, those of a query's ``bar`` and more where it has one.

    ``left``: vectors with shard and part; ``right``: queries with shard, part and bar.
    """

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            q, v = matrix(asked["v"], width), matrix(rows["v"], width)
            if width * max(1.0, np.abs(q).max()) * max(1.0, np.abs(v).max()) >= EXACT:  # whole numbers of any size instead
                q, v = (np.array([[int(x) for x in row] for row in m], object) for m in (q, v))
            order = np.lexsort((rows["vec_id"].to_numpy(), -(v * v).sum(axis=1)))
            ids, v = rows["vec_id"].to_numpy()[order], v[order]
            blocks, names = blocks_of(v), asked["vec_id"].to_numpy()
            bars = [None if b is None or b != b else int(b) for b in asked["bar"]]
            out = [search_tile(ids, v, query_id, own, k, blocks=blocks, least=bar) for query_id, own, bar in zip(names, q, bars, strict=True)]
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        number = np.repeat(names, [len(found) for found, _ in out])
        return pd.DataFrame({"query_id": number, "vec_id": np.concatenate([f for f, _ in out]), "score": np.concatenate([s.astype(np.int64) for _, s in out])})

    return left.groupBy("part", "shard").cogroup(right.groupBy("part", "shard")).applyInPandas(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score; both inputs as ``integer_vectors`` gives them."""
    width, n = vectors.agg(F.max(F.size("v")), F.count("*")).first()
    asked = queries.count()
    shards, parts = max(1, -(-n // VECTORS)), max(1, -(-asked // QUERIES))
    spread = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    left = vectors.withColumn("shard", spread("vec_id", shards)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # columns of their own, as both sides may come from one table
    queries = queries.select(F.col("vec_id").alias("vec_id"), F.col("v").alias("v"), spread("vec_id", parts).alias("part"))
    right = queries.withColumn("bar", F.lit(None).cast("string"))
    over = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    low, best = 0, None
    while low < shards:
        high = min(shards, max(1, GROWTH * low) if low else GROWTH)
        own = right.withColumn("shard", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        found = scored_tiles(left.where(F.col("shard").between(low, high - 1)), own, width, k)
        found = found if best is None else best.unionByName(found)
        best = found.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        low = high
        if low < shards:
            best = cut(best, "best-so-far")
            bars = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("string").alias("bar"))
            best, right = best.drop("rank"), queries.join(bars, "vec_id", "left")
    return best


TOP_K_ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
