"""Alignment of two tokenizers' tokens on the bytes of each text, and how many documents link each pair of ids.

An Arrow pipeline in two passes over Spark partitions:

1. A slice of texts becomes two flat lists of ids, A (byte-level BPE of a space and the text) and B (sentencepiece BPE of
   the text, which adds the space itself). Flattened, each token has its document as parent index; a segmented cumulative
   sum of token lengths gives its end within the document. A hash join on (document, end) finds the places where
   tokens of both end: they cut the document into groups. Tokens whose byte ranges overlap are links. ``Table.group_by`` counts a
   document's links by id pair, and the documents of a partition by id pair; Spark adds the partitions' counts.
2. Each document's links meet the counts of their pairs. A pair is ``top`` if no pair of its A id is linked in more documents.
   Up to FEW_PAIRS pairs, counted first, go to the workers as two arrays; beyond, links and counts are joined by pair,
   pairs with many documents dealt to several tasks.

Texts whose tokens of either side don't give back the bytes of a space and the text (those with U+2581) have no tokens.

Defined results: a null or empty text has no tokens, which is zeros and an empty string of groups; strings of special
tokens are ordinary text; null and repeated doc_ids are rows and documents of their own each; an empty table gives no rows; other columns are ignored.
A text of any length is one slice, with arrays of about a hundred bytes for each of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .base import cut, join_keyed
from .pieces import PieceEncoder, Pieces
from .tokens import KEPT, Encoder, _byte_letters, _bytes_of, _ranges, slices

#: Bytes of texts that are aligned at once, or one text.
SLICE = 2_000_000
#: Up to so many id pairs their counts go to every worker (16 bytes each).
FEW_PAIRS = 4_000_000
#: Partial counts that a task gathers before it sends them.
GATHERED = 1_000_000

LINKED = StructType(
    [
        StructField("doc_id", LongType()),
        *(StructField(name, LongType()) for name in ("n_a", "n_b", "n_groups", "n_links")),
        StructField("groups_sha256", StringType()),
        StructField("pairs", ArrayType(LongType())),
        StructField("times", ArrayType(IntegerType())),
    ]
)
_ARROW = to_arrow_schema(LINKED)


class _Table:
    """Strings of bytes by id, laid end to end."""

    def __init__(self, rows: list[bytes]):
        self.size = np.array([len(r) for r in rows], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(rows), np.uint8)

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of these ids one after the other, and where each begins and the last ends."""
        place, ends = _ranges(self.begin[ids], self.size[ids])
        return self.data[place], ends


def byte_level_bytes(tokenizer) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary."""
    value = {ord(letter): byte for byte, letter in _byte_letters().items()}
    names = {i: name for name, i in tokenizer.get_vocab().items()}
    # names of added tokens aren't written in those letters; no text gives their ids
    return [bytes(value.get(ord(c), 0) for c in names.get(i, "")) for i in range(max(names) + 1)]


class Aligner:
    def __init__(self, a_path: str, b_path: str, kept: int = KEPT):
        self.a, self.b = Encoder(a_path, spaces=True, lead=True, kept=kept), PieceEncoder(b_path, kept=kept)
        self.a_bytes, self.b_bytes = _Table(byte_level_bytes(self.a.tokenizer)), _Table(self.b.pieces.bytes_of)
        ids = max(len(self.a_bytes.size), len(self.b_bytes.size))
        self.digits = _Table([f"{i} ".encode() for i in range(ids)])  # the blank stands for the sign that follows the id
        self.width = len(self.b_bytes.size)  # a pair is A id * width + B id

    def align(self, texts: pa.Array) -> dict[str, pa.Array | np.ndarray]:
        """The columns of LINKED but doc_id for a slice of large strings."""
        n = len(texts)
        (ids_a, ends_a), (ids_b, ends_b) = self.a.encode(texts), self.b.encode(texts)
        good = self._lossless(texts, self.a_bytes, ids_a, ends_a) & self._lossless(texts, self.b_bytes, ids_b, ends_b)
        a, b = _Side(self.a_bytes, ids_a, ends_a, good), _Side(self.b_bytes, ids_b, ends_b, good)
        # places where tokens of both end
        shared = a.ends("a").join(b.ends("b"), keys=["doc", "end"], join_type="inner", use_threads=False)
        last_a, last_b = np.sort(shared["a"].to_numpy()), np.sort(shared["b"].to_numpy())
        groups = np.bincount(a.doc[last_a], minlength=n)
        # b tokens whose ranges overlap that of an a token: the first that ends after its begin to the last that begins before its end
        low, high = np.searchsorted(b.stop, a.start, "right"), np.searchsorted(b.start, a.stop, "left")
        place, _ = _ranges(low, high - low)
        number = np.repeat(a.ids.astype(np.int64), high - low) * self.width + b.ids[place]
        doc = np.repeat(a.doc, high - low)
        links = pa.table({"doc": doc, "pair": number}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
        links = links.sort_by([("doc", "ascending"), ("pair", "ascending")])
        upto = np.concatenate([[0], np.cumsum(np.bincount(links["doc"].to_numpy(), minlength=n))]).astype(np.int32)
        lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(upto), values.combine_chunks().cast(kind.value_type), type=kind)
        return {
            "n_a": a.count, "n_b": b.count, "n_groups": groups, "n_links": np.bincount(doc, minlength=n), "groups_sha256": self._digests(a, b, last_a, last_b, n),
            "pairs": lists(links["pair"], _ARROW.field("pairs").type), "times": lists(links["count_all"], _ARROW.field("times").type),
        }

    def _lossless(self, texts: pa.Array, table: _Table, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the tokens of each text give a space and its bytes; False for empty texts."""
        data, offsets = _bytes_of(texts)
        want = np.diff(offsets)
        got, at = table.joined(ids)
        begin, size = at[ends[:-1]], np.diff(at[ends])
        good = (want > 0) & (size == want + 1)
        some = np.flatnonzero(good)
        good[some] = got[begin[some]] == 0x20
        mine, upto = _ranges(begin[some] + 1, want[some])
        theirs, _ = _ranges(offsets[some], want[some])
        if len(some):
            good[some] &= ~np.logical_or.reduceat(got[mine] != data[theirs], upto[:-1])
        return good

    def _digests(self, a: _Side, b: _Side, last_a: np.ndarray, last_b: np.ndarray, n: int) -> list[str]:
        """Hashes of the groups' ids, written as bytes for the whole slice: a group's A ids, then its B ids."""
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        order = np.empty(len(a.ids) + len(b.ids), np.int64)  # in what order the ids are written
        of_a = np.arange(len(a.ids)) + np.repeat(np.cumsum(size_b) - size_b, size_a)
        of_b = np.arange(len(b.ids)) + np.repeat(np.cumsum(size_a), size_b)
        order[of_a], order[of_b] = a.ids, b.ids
        data, ends = self.digits.joined(order)
        sign = np.full(len(order), ord(","), np.uint8)
        sign[of_a[last_a]], sign[of_b[last_b]] = ord("|"), ord(";")
        data[ends[1:] - 1] = sign
        upto = ends[np.concatenate([[0], np.cumsum(a.count + b.count)])].tolist()
        seen = memoryview(data)
        return [hashlib.sha256(seen[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(upto, upto[1:], strict=False)]


class _Side:
    """One tokenizer's tokens of the texts that keep their bytes."""

    def __init__(self, table: _Table, ids: np.ndarray, ends: np.ndarray, good: np.ndarray):
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
        lists = pc.if_else(pa.array(good), lists, pa.scalar([], lists.type))
        self.ids, self.doc = pc.list_flatten(lists).to_numpy(), pc.list_parent_indices(lists).to_numpy()
        self.count = pc.list_value_length(lists).to_numpy()
        size = table.size[self.ids]
        #: Byte ranges in all these texts, one after the other; both sides have the same texts, so these compare across sides.
        self.stop = np.cumsum(size)
        self.start = self.stop - size
        first = np.cumsum(self.count) - self.count  # of each document
        base = np.concatenate([self.start, self.stop[-1:], [0]])[np.minimum(first, len(self.ids))]
        self.end = self.stop - base[self.doc]

    def ends(self, number: str) -> pa.Table:
        """Document, end within it, and ``number`` for each token."""
        return pa.table({"doc": self.doc, "end": self.end, number: np.arange(len(self.ids))})


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process and pair of files."""
    return Aligner(a_path, b_path)


def linked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The columns of LINKED for every row of ``docs`` (doc_id, text): the sides' numbers of tokens, groups and links, the hash of
    the groups, and the id pairs that the document links with how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, at = batch.column(0), 0
            for texts in slices(batch.column(1), SLICE):
                out = aligner(a_path, b_path).align(texts) | {"doc_id": doc_ids.slice(at, len(texts))}
                at += len(texts)
                columns = [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in _ARROW]
                yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)
            pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, LINKED)


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])


def pair_counts(links: DataFrame, width: int) -> DataFrame:
    """pair, n (documents that link it) and top (no pair of its A id has more), of ``links`` as ``linked`` gives them."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            pairs = pc.list_flatten(batch.column(0))
            held.append(_summed([pa.table({"pair": pairs, "n": pa.array(np.ones(len(pairs), np.int64))})]))
            rows += held[-1].num_rows
            if rows > GATHERED:
                held = [_summed(held)]
                rows = held[0].num_rows
                if 2 * rows > GATHERED:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from _summed(held).to_batches()

    counts = links.select("pairs").mapInArrow(partial, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    of_a = Window.partitionBy(F.floor(F.col("pair") / width))  # as many rows as the other vocabulary has ids, at most
    return counts.withColumn("top", F.col("n") == F.max("n").over(of_a))


def _looked_up(links: DataFrame, counts: DataFrame) -> DataFrame:
    """``links`` with n_best and count_sum, for counts that fit in every worker."""
    known = counts.orderBy("pair").toArrow()
    shared = links.sparkSession.sparkContext.broadcast(tuple(known[c].to_numpy() for c in ("pair", "n", "top")))
    kept = [f for f in LINKED if f.name not in ("pairs", "times")]
    schema = StructType([*kept, StructField("n_best", LongType()), StructField("count_sum", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, top = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                lists = part.column("pairs")
                at = np.searchsorted(pair, pc.list_flatten(lists).to_numpy())
                times = pc.list_flatten(part.column("times")).to_numpy().astype(np.int64)
                upto = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
                sums = [np.diff(np.concatenate([[0], np.cumsum(times * each[at])])[upto]) for each in (top, n)]
                columns = [*(part.column(f.name) for f in kept), *map(pa.array, sums)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return links.drop("row").mapInArrow(run, schema)


def _joined(links: DataFrame, counts: DataFrame) -> DataFrame:
    """As ``_looked_up``, by a join on pairs."""
    each = cut(links.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", "link.pairs", "link.times").withColumnRenamed("pairs", "pair"), "pair-links")
    found = join_keyed(each, counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("top"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")}
    return links.drop("pairs", "times").join(found, "row", "left").withColumns(zero).drop("row")


def align_tokens(docs: DataFrame, a_path: str, b_path: str, few: int = FEW_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row of ``docs`` (doc_id, text).

    ``n_best``: links whose pair is ``top``; ``count_sum``: over links, how many documents link their pair.
    """
    links = cut(linked(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()), "token-links", compression="zstd")
    counts = cut(pair_counts(links, len(Pieces(b_path).bytes_of)), "pair-counts")
    done = _looked_up(links, counts) if counts.count() <= few else _joined(links, counts)
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
