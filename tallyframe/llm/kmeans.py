"""Centroid clustering in whole numbers, with distances bounded from below in a rotated space.

Vectors are floors of scaled components. A rotation to their principal axes, found from the sums of all vectors and of
their products, keeps distances; each vector is stored with its LEADING rotated coordinates and the norm of the rest.
Between a vector and a centroid the projected distance plus the squared difference of these norms is at most the squared
distance. A vector is compared in whole numbers with the centroid of least bound; only centroids whose bound isn't above that
distance (with a margin for rounding, SLACK) are compared too. So the rotation only decides how much work is left, never the result.

Centroids start as the vectors of least hash. Each round is one pass over the written vectors: tasks add up the vectors of each
cluster, Spark adds the tasks' sums, and the driver gets K sums of WIDTH components, whatever the number of vectors; the
next centroids are their floors of sum / count. A cluster with a third of all vectors is just a larger sum. Inertia is
summed by cluster and joined as a table of at most K rows.

Defined results: rows whose vector is null, of another length or holds null or non-finite components are left out; a row with
null vec_id takes part but is never a start; rows that repeat a vec_id are vectors each, and among them the start is the one of
the lexicographically least components, and the copies of a start are starts too while there is room; fewer than K vectors give fewer centroids; no
vectors, or none with a vec_id, give no rows. Components beyond 2**27 after scaling count as 2**27, so every distance is a
long; an inertia that is none is null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut

WIDTH = 64
SCALE = 256
K = 40
ROUNDS = 5
#: Coordinates of the rotated vectors that are stored.
LEADING = 16
#: Vectors compared at once.
BLOCK = 4_096
MOST = 1 << 27
#: What rounding may add to a bound, relative to the squared lengths it comes from; doubles err by about 1e-14 of these here.
SLACK = 1e-9


def _fine(x: Column, width: int) -> Column:
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    return x.isNotNull() & (F.size(x) == width) & whole


def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the floors of the scaled components, of the rows that take part."""
    bound = lambda c: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), scale * c.cast("double")))
    return rows.where(_fine(F.col(vector), width)).select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda c: F.floor(bound(c)).cast("int")).alias("v"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False).reshape(-1, width)


def starts(vectors: DataFrame, k: int = K) -> np.ndarray:
    """The k vectors whose vec_id has the least hash, in its order; k rows reach the driver."""
    hashed = vectors.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256).alias("hash"), "v")
    return np.array([r["v"] for r in hashed.orderBy("hash", "v").limit(k).collect()], np.int64).reshape(-1, WIDTH)


def rotation(vectors: DataFrame, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The mean of all vectors, and their principal axes as columns, the widest first. Each task sends its sums as one row of fixed size."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + width + width * width)
        for batch in batches:
            x = matrix(batch.column(0), width).astype(np.float64)
            total += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "x"])

    rows = vectors.select("v").mapInArrow(sums, "place int, x double").groupBy("place").agg(F.sum("x").alias("x")).orderBy("place").collect()
    x = np.array([r["x"] for r in rows])
    mean = x[1 : 1 + width] / x[0]
    _, axes = np.linalg.eigh(x[1 + width :].reshape(width, width) / x[0] - np.outer(mean, mean))
    return mean, axes[:, ::-1]


class Space:
    """Rotated coordinates: LEADING of them, then the norm of the rest."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, leading: int = LEADING):
        self.mean, self.axes, self.leading = mean, axes, leading

    def of(self, x: np.ndarray) -> np.ndarray:
        y = (x - self.mean) @ self.axes
        return np.concatenate([y[:, : self.leading], np.sqrt((y[:, self.leading :] ** 2).sum(axis=1, keepdims=True))], axis=1)


def nearest(x: np.ndarray, near: np.ndarray, centroids: np.ndarray, near_centroids: np.ndarray, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector, the smaller of ties, and the squared distance.

    near, near_centroids: what ``Space.of`` gives for them.
    """
    lengths = (near**2).sum(axis=1)[:, None] + (near_centroids**2).sum(axis=1)[None, :]
    bound = lengths - 2 * (near @ near_centroids.T) - SLACK * (lengths + 1)
    rows = np.arange(len(x))
    cluster = bound.argmin(axis=1)
    distance = ((x - centroids[cluster]) ** 2).sum(axis=1)
    bound[rows, cluster] = np.inf
    row, other = np.nonzero(bound <= distance[:, None])
    exact = ((x[row] - centroids[other]) ** 2).sum(axis=1)
    if stats is not None:
        stats["distances"] = stats.get("distances", 0) + len(x) + len(row)
    # of each vector's survivors the least distance, then the smallest number
    all_row, all_cluster, all_distance = np.concatenate([rows, row]), np.concatenate([cluster, other]), np.concatenate([distance, exact])
    order = np.lexsort((all_cluster, all_distance, all_row))
    first = order[np.searchsorted(all_row[order], rows)]
    return all_cluster[first], all_distance[first]


def _blocks(batches: Iterator[pa.RecordBatch], width: int, near: int):
    """Numbers, vectors and rotated coordinates of rows (vec_id, v, near)."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part.column(0), matrix(part.column(1), width).astype(np.int64), matrix(part.column(2), near)


def rotated(vectors: DataFrame, space: Space, width: int = WIDTH) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = space.of(matrix(batch.column(1), width).astype(np.float64))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), near.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["vec_id", "v", "near"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<int>, near array<double>")


def moved(vectors: DataFrame, space: Space, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of sum / count of each one's vectors."""
    k, width = centroids.shape
    near = space.of(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), np.int64)
        for _, x, own in _blocks(batches, width, near.shape[1]):
            cluster, _ = nearest(x, own, centroids, near)
            np.add.at(total, cluster, np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1))
        number = np.repeat(np.arange(k, dtype=np.int32), width + 1)
        place = np.tile(np.arange(width + 1, dtype=np.int32), k)
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(place), pa.array(total.ravel())], names=["cluster", "place", "x"])

    rows = vectors.mapInArrow(sums, "cluster int, place int, x long").groupBy("cluster", "place").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((k, width + 1), object)
    for r in rows:
        total[r["cluster"], r["place"]] = r["x"]
    full = total[:, -1] > 0
    out = centroids.copy()
    out[full] = (total[full, :-1] // total[full, -1:]).astype(np.int64)
    return out


ASSIGNED = "vec_id long, cluster int, distance long"


def assigned(vectors: DataFrame, space: Space, centroids: np.ndarray) -> DataFrame:
    near = space.of(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, own in _blocks(batches, *centroids.shape[1:], *near.shape[1:]):
            cluster, distance = nearest(x, own, centroids, near)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, ASSIGNED)


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for every row of ``rows`` (vec_id, embedding) that takes part."""
    spark = rows.sparkSession
    vectors = integer_vectors(rows)
    centroids = starts(vectors, k)
    if not len(centroids):
        return spark.createDataFrame([], f"{ASSIGNED}, cluster_inertia long, inertia long, centroid_sha256 string")
    space = Space(*rotation(vectors))
    stored = cut(rotated(vectors, space), "rotated-vectors")
    for _ in range(rounds):
        after = moved(stored, space, centroids)
        if (after == centroids).all():
            break  # the rounds that are left would change nothing
        centroids = after
    done = cut(assigned(stored, space, centroids), "clusters")
    # one row per centroid, so at most k
    sums = [(r["cluster"], int(r["n"])) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()]
    long = lambda n: n if n < 1 << 63 else None
    total = long(sum(n for _, n in sums))
    named = [(c, long(n), total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in sums]
    return done.join(F.broadcast(spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _oracle() -> str:
    """The same in DuckDB, each vector against each centroid."""
    rounds = "".join(
        f"""
a{i} AS MATERIALIZED (SELECT rid, min((p.xx - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v))::BIGINT * 64 + c.k) AS m FROM p, c{i} c GROUP BY rid),
""" + (f"""
s{i} AS (SELECT k, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a{i}.m % 64 AS k, unnest(p.v)::BIGINT AS x, generate_subscripts(p.v, 1) AS j FROM a{i} JOIN p USING (rid)) GROUP BY k, j),
m{i} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY j) AS v FROM s{i} GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (k)),""" if i < ROUNDS else "")
        for i in range(ROUNDS + 1)
    )
    return f"""
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
i AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(greatest(-{MOST}, least({MOST}, {SCALE} * x::DOUBLE)))) AS v FROM e),
p AS MATERIALIZED (SELECT *, list_inner_product(v, v) AS xx FROM i),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM p WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {K})),
{rounds}
d AS (SELECT p.vec_id, (m % 64)::INTEGER AS cluster, m // 64 AS distance FROM a{ROUNDS} JOIN p USING (rid)),
n AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM d GROUP BY cluster)
SELECT vec_id, cluster, distance, cluster_inertia, (SELECT sum(distance)::BIGINT FROM d) AS inertia, sha256(array_to_string(c.v::BIGINT[], ',')) AS centroid_sha256
FROM d JOIN n USING (cluster) JOIN c{ROUNDS} c ON c.k = d.cluster
"""


CLUSTER_ORACLE = _oracle()
