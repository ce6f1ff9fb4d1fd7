"""A byte-level convolutional network in numpy that scores whole texts.

A text is its UTF-8 bytes, cut into overlapping chunks that cover all of it. Filters of WIDTH bytes run over byte
embeddings at every STRIDE-th byte; each chunk keeps the maximum and the mean of every filter. The chunks' maxima and
means are combined into their maximum and mean over the document, and a linear layer and a sigmoid make one probability.

Fitting reads at most SAMPLE labelled documents of each class (those of the least hash of doc_id, so the choice is the
same at every run), each with all its chunks: the driver holds the bytes of these 2 * SAMPLE texts, and besides them the
activations of PIECE chunks at a time, however long a document is. Scoring reads whole texts.

Defined results: a null or empty text is one chunk of padding and gets a score like any other; a null doc_id is not held
out, is never fitted on, and is scored; labels that are null, or that differ for one doc_id, are not used; rows that
repeat are scored each; without labels of both classes the score is the share of label 1, or 0.5 without any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .base import map_rows

#: Labelled documents of each class that fitting reads at most.
SAMPLE = 1200
#: Chunks whose activations are held at once while fitting.
PIECE = 256
EPOCHS = 8
CHUNK, OVERLAP = 1024, 64
WIDTH, STRIDE = 8, 4
EMBED, FILTERS = 8, 32
RATE = 0.01
BATCH = 32
GOOD_COST = 2.0

Weights = dict[str, np.ndarray]


def chunks(data: bytes) -> np.ndarray:
    """Overlapping chunks over all bytes, as a matrix; the last is padded with zero bytes."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + CHUNK, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (step, 1))


def start_weights(seed: int = 7) -> Weights:
    r = np.random.default_rng(seed)
    return {
        "embed": r.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "filters": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": r.normal(0, 0.1, 4 * FILTERS).astype(np.float32),
        "out_bias": np.zeros(1, np.float32),
    }


def windows(x: np.ndarray) -> np.ndarray:
    """Places of the filters: (chunks, places, WIDTH) bytes."""
    return np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)[:, ::STRIDE]


def chunk_features(x: np.ndarray, w: Weights) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Maximum and mean of each filter in each chunk, and what going back needs. Padding counts for neither."""
    seen = windows(x)
    inputs = w["embed"][seen].reshape(*seen.shape[:2], -1)
    active = np.maximum(inputs.reshape(-1, WIDTH * EMBED) @ w["filters"] + w["bias"], 0).reshape(*seen.shape[:2], FILTERS)
    real = np.maximum((seen != 0).any(axis=2), np.arange(seen.shape[1]) == 0)
    active *= real[:, :, None]
    return active.max(axis=1), active.sum(axis=1) / real.sum(axis=1)[:, None], (seen, inputs, active, real)


def combine(high: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return np.concatenate([high.max(axis=0), high.mean(axis=0), mean.max(axis=0), mean.mean(axis=0)])


def _back(back_high: np.ndarray, back_mean: np.ndarray, w: Weights, held: tuple) -> Weights:
    """Gradients of one piece of chunks, given those of its chunks' maxima and means."""
    seen, inputs, active, real = held
    g_active = np.repeat((back_mean / real.sum(axis=1)[:, None])[:, None, :], active.shape[1], axis=1)
    g_active[np.arange(len(active))[:, None], active.argmax(axis=1), np.arange(FILTERS)[None, :]] += back_high
    g_active = (g_active * (active > 0)).reshape(-1, FILTERS).astype(np.float32)
    g_in = (g_active @ w["filters"].T).reshape(-1, EMBED)
    places = seen.reshape(-1)
    embed = np.stack([np.bincount(places, weights=g_in[:, e], minlength=256) for e in range(EMBED)], axis=1)
    return {"filters": inputs.reshape(-1, WIDTH * EMBED).T @ g_active, "bias": g_active.sum(axis=0), "embed": embed}


def _gradients(data: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, w: Weights) -> Weights:
    """Gradients of the weighted log loss of some documents, over all their chunks, a piece at a time."""
    x = np.concatenate(data)
    pieces = [slice(at, at + PIECE) for at in range(0, len(x), PIECE)]
    seen = [chunk_features(x[p], w) for p in pieces[:1]] if len(pieces) == 1 else [(*chunk_features(x[p], w)[:2], None) for p in pieces]
    high, mean = np.concatenate([f[0] for f in seen]), np.concatenate([f[1] for f in seen])
    ends = np.cumsum([len(d) for d in data])
    spans = [slice(e - len(d), e) for d, e in zip(data, ends, strict=True)]
    docs = np.stack([combine(high[s], mean[s]) for s in spans])
    score = 1 / (1 + np.exp(-np.clip(docs @ w["out"] + w["out_bias"], -30, 30)))
    error = ((score - labels) * weight / len(data)).astype(np.float32)
    back = np.outer(error, w["out"]).reshape(len(data), 4, FILTERS)
    back_high, back_mean, f = np.zeros_like(high), np.zeros_like(mean), np.arange(FILTERS)
    for k, s in enumerate(spans):
        n = s.stop - s.start
        back_high[s] += back[k, 1] / n
        back_high[s.start + high[s].argmax(axis=0), f] += back[k, 0]
        back_mean[s] += back[k, 3] / n
        back_mean[s.start + mean[s].argmax(axis=0), f] += back[k, 2]
    g = {"out": docs.T @ error, "out_bias": error.sum(keepdims=True)}
    for p, (_, _, held) in zip(pieces, seen, strict=True):  # activations of several pieces are made anew, not kept
        for name, own in _back(back_high[p], back_mean[p], w, held or chunk_features(x[p], w)[2]).items():
            g[name] = g[name] + own if name in g else own
    return g


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> Weights:
    """Stochastic gradient descent (Adam) on log loss. A line of a good text is good too: one of each is added, so that
    short texts are known. Rejecting a good text costs GOOD_COST times as much as keeping a bad one."""
    w, r = start_weights(seed), np.random.default_rng(seed)
    lines = [r.choice(t.split("\n")) for t, q in zip(texts, labels, strict=True) if q == 1]
    texts, labels = texts + lines, np.concatenate([labels, np.ones(len(lines), np.float32)])
    data = [chunks(text.encode()) for text in texts]  # views that overlap: no more than the texts' bytes
    weight = np.where(labels == 1, GOOD_COST, 1) * np.where(np.arange(len(labels)) < len(labels) - len(lines), 1, 0.5)
    m, v, t = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    for epoch in range(EPOCHS):
        order = r.permutation(len(data))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            g = _gradients([data[i] for i in own], labels[own], weight[own], w)
            t += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] = (w[k] - RATE * (0.5 if epoch >= EPOCHS // 2 else 1) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def score(text: str | None, w: Weights) -> float:
    """The probability of label 1, over all chunks of the whole text; long texts go through in pieces."""
    own = chunks((text or "").encode())
    parts = [chunk_features(own[i : i + 16], w)[:2] for i in range(0, len(own), 16)]
    doc = combine(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    return float(1 / (1 + np.exp(-np.clip(doc @ w["out"] + w["out_bias"][0], -30, 30).astype(np.float64))))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """At most ``sample`` documents of each class that are not held out; this many reach the driver, at any size."""
    known = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    known = known.select("doc_id", F.col("low").cast("int").alias("label"))
    of = lambda q: known.where(F.col("label") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = F.broadcast(of(0).unionByName(of(1)))  # 2 * sample rows of two numbers
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample).collect()
    return [r["text"] or "" for r in rows], np.array([r["label"] for r in rows], np.float32)


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[Weights | None, float]:
    """Weights, or None and a constant score where the labels don't have both classes."""
    texts, known = training_rows(docs, labels)
    if len(set(known.tolist())) == 2:
        return fit(texts, known), 0.0
    return None, float(known.mean()) if len(known) else 0.5


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``; fitted on ``labels`` (doc_id, quality)."""
    weights, constant = fitted(docs, labels)
    schema = StructType([StructField("doc_id", LongType()), StructField("score", DoubleType())])

    def run(doc_ids: pa.Array, texts: pa.Array) -> dict[str, list]:
        return {"doc_id": doc_ids, "score": [constant if weights is None else score(t.as_py(), weights) for t in texts]}

    scored = map_rows(docs, ["doc_id", "text"], run, schema)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with all their columns; no shuffle."""
    weights, constant = fitted(docs, labels)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index("text"))
            yield batch.filter(pa.array([(constant if weights is None else score(t.as_py(), weights)) >= 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
