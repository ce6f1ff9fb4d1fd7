"""Token ids in compressed files: a static range asymmetric numeral system over one shared frequency table.

A folder holds two Parquet tables. ``table`` has the frequency of each id, scaled to 2**SCALE over the whole corpus.
``blocks`` has the ids in ascending doc_id order, in blocks of whole documents that are coded independently:

* ids are dealt to interleaved lanes in turn; each lane is a coder of its own with a 64-bit state, and all lanes share
  one stream of 32-bit words, so that a step of all lanes is a few array operations;
* ``states`` are the lanes' states at the block's start, and every ``CHECKPOINT`` steps the states and the place in the
  stream are kept; from one checkpoint to the next is a section, and ``crcs`` checks the ids of each section;
* ``file``, ``block`` and ``first`` (ids in the file before the block) are the directory.

Reading deals the sections out, each with its checkpoint and its part of the stream only, so that many tasks share a long
block. A document that reaches over sections comes in fragments, whose checksums are combined without their ids.

Defined results: a null or empty text has the end id alone; a null doc_id comes first; rows with the same doc_id
follow each other in the order of their checksums, so that a rerun gives each the same place; an empty table gives no
blocks and no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .base import cut, map_rows, shared_dir
from .tokens import encoder

END_ID = 2
SCALE = 20
LOW = np.uint64(1 << 31)  # a state is in [2**31, 2**63)
WORD_BITS = np.uint64(32)
LANES = 2048
#: Up to so many files their first places are broadcast (about 20 bytes each); beyond, they are joined.
FEW_FILES = 1_000_000
#: A block is closed when it holds so many ids; one very long document may make it longer.
BLOCK = 1 << 19
#: Steps from one checkpoint to the next.
CHECKPOINT = 128
#: What the encoder keeps and cuts at once here: more than its defaults, as this job's workers hold little else.
KEPT, SLICE = 500_000, 4_000_000
#: Ids a file holds about.
FILE = 1 << 23

TOKENS = StructType([StructField("doc_id", LongType()), StructField("n_tokens", LongType()), StructField("crc32", LongType()), StructField("ids", BinaryType())])
BLOCKS = StructType(
    [
        StructField("file", IntegerType()),
        StructField("block", IntegerType()),
        StructField("first", LongType()),
        StructField("n_tokens", LongType()),
        StructField("doc_ids", ArrayType(LongType())),
        StructField("sizes", ArrayType(LongType())),
        StructField("lanes", IntegerType()),
        StructField("states", BinaryType()),
        StructField("words", BinaryType()),
        StructField("check_words", ArrayType(LongType())),
        StructField("check_states", BinaryType()),
        StructField("crcs", ArrayType(LongType())),
    ]
)
#: What one task decodes: a section with its checkpoint.
SECTION = StructType(
    [
        StructField("file", IntegerType()),
        StructField("block", IntegerType()),
        StructField("section", IntegerType()),
        StructField("first", LongType()),
        StructField("n_tokens", LongType()),
        StructField("doc_ids", ArrayType(LongType())),
        StructField("sizes", ArrayType(LongType())),
        StructField("lanes", IntegerType()),
        StructField("states", BinaryType()),
        StructField("words", BinaryType()),
        StructField("crc32", LongType()),
    ]
)
FRAGMENTS = StructType(
    [
        StructField("file", IntegerType()),
        StructField("doc_id", LongType()),
        StructField("place", LongType()),
        StructField("n_tokens", LongType()),
        StructField("section", IntegerType()),
        StructField("n", LongType()),
        StructField("crc32", LongType()),
        StructField("ids", BinaryType()),
    ]
)


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**scale, at least 1 for each id that occurs."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.uint32)
    share = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * (1 << scale) // total), 0).astype(np.int64)
    spare = (1 << scale) - int(share.sum())
    for i in np.argsort(-share, kind="stable"):  # the most frequent ids take what rounding left, or give it
        change = max(spare, 1 - int(share[i])) if spare < 0 else spare
        share[i] += change
        spare -= change
        if not spare:
            return share.astype(np.uint32)
    raise ValueError(f"more distinct ids than 2**{scale}")


@lru_cache(maxsize=2)
def _tables(table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    freq = np.frombuffer(table, "<u4").astype(np.uint64)
    return freq, np.cumsum(freq) - freq, np.repeat(np.arange(len(freq)), freq.astype(np.int64))


def encode_block(ids: np.ndarray, table: bytes) -> dict:
    """Code the last step first, as a decoder takes out last what went in first."""
    freq, before, _ = _tables(table)
    lanes = max(1, min(LANES, len(ids) // 64))
    steps = -(-len(ids) // lanes)
    ids = ids.astype(np.intp)  # what arrays are indexed with
    x, chunks, checks = np.full(lanes, LOW, np.uint64), [], []
    limit = np.uint64(31 - SCALE + 32)
    for t in range(steps - 1, -1, -1):
        s = ids[t * lanes : (t + 1) * lanes]
        own, f = x[: len(s)], freq[s]
        over = own >= (f << limit)
        chunks.append((own[over] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        own[over] >>= WORD_BITS
        q = own // f
        x[: len(s)] = (q << np.uint64(SCALE)) + (own - q * f) + before[s]
        if t and t % CHECKPOINT == 0:
            checks.append((t, x.copy()))
    chunks.reverse()
    checks.reverse()
    place = np.concatenate([[0], np.cumsum([len(c) for c in chunks])])
    return {
        "lanes": lanes,
        "states": x.astype("<u8").tobytes(),
        "words": b"".join(c.tobytes() for c in chunks),
        "check_words": [int(place[t]) for t, _ in checks],
        "check_states": b"".join(c.astype("<u8").tobytes() for _, c in checks),
    }


def decode_section(states: bytes, words: bytes, n: int, lanes: int, table: bytes) -> np.ndarray:
    """The ``n`` ids from a checkpoint on, given the lanes' states there and the stream from there on."""
    freq, before, symbol = _tables(table)
    x, stream, at = np.frombuffer(states, "<u8").astype(np.uint64), np.frombuffer(words, "<u4"), 0
    out = np.empty(n, np.uint32)
    mask = np.uint64((1 << SCALE) - 1)
    for begin in range(0, n, lanes):
        m = min(lanes, n - begin)
        own = x[:m]
        slot = own & mask
        s = symbol[slot.view(np.int64)]
        out[begin : begin + m] = s
        own = freq[s] * (own >> np.uint64(SCALE)) + slot - before[s]
        need = own < LOW
        more = int(need.sum())
        own[need] = (own[need] << WORD_BITS) | stream[at : at + more]
        at += more
        x[:m] = own
    return out


def sections(block: dict) -> list[tuple[bytes, bytes, int]]:
    """States, part of the stream and number of ids of each section of a block."""
    lanes, n = block["lanes"], int(block["n_tokens"])
    places = [0, *(4 * w for w in block["check_words"]), len(block["words"])]
    states = [block["states"], *(block["check_states"][at : at + 8 * lanes] for at in range(0, len(block["check_states"]), 8 * lanes))]
    size = CHECKPOINT * lanes
    return [(own, block["words"][places[k] : places[k + 1]], min(size, n - k * size)) for k, own in enumerate(states)]


def joined_crc(first: int, second: int, size: int) -> int:
    """The crc32 of two runs of bytes from theirs: the first is carried over ``size`` zero bytes by squaring the step of one."""

    def times(matrix: list[int], vector: int) -> int:
        out = 0
        for row in matrix:
            if vector & 1:
                out ^= row
            vector >>= 1
        return out

    step = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit
    for _ in range(3):
        step = [times(step, row) for row in step]  # one zero byte
    while size:
        if size & 1:
            first = times(step, first)
        step = [times(step, row) for row in step]
        size >>= 1
    return first ^ second


def token_ids(docs: DataFrame, vocabulary: str, added: bool = False) -> DataFrame:
    """doc_id, number of ids with the end id, and the ids as little-endian integers of 16 bits (32 for large vocabularies) with their checksum."""

    schema = to_arrow_schema(TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, False, KEPT, SLICE, added)
        kind = _kind(own.tokenizer.get_vocab_size())
        width = np.dtype(kind).itemsize
        for batch in batches:
            at = 0
            for ids, ends in own.batches(batch.column(1)):  # a slice at a time, to hold few ids at once
                whole = memoryview(np.insert(ids, ends[1:], END_ID).astype(kind)).cast("B")
                ends = width * (ends + np.arange(len(ends)))
                rows = [whole[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                # the ids lie one text after the other already, so the binary column is this buffer and where each ends
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(whole)]).cast(pa.binary())
                out = [batch.column(0).slice(at, len(rows)), pa.array(np.diff(ends) // width), pa.array([zlib.crc32(r) for r in rows], pa.int64()), column]
                at += len(rows)
                yield pa.RecordBatch.from_arrays(out, schema=schema)
            pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, TOKENS)


def _kind(vocabulary_size: int) -> str:
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def frequency_table(tokens: DataFrame, vocabulary_size: int) -> bytes:
    """Counts of every id in the corpus; at most one row per id of the vocabulary reaches the driver."""
    kind = _kind(vocabulary_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary_size, np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=vocabulary_size)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], names=["id", "n"])

    counts = np.zeros(vocabulary_size, np.int64)
    for row in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    return scaled(counts).astype("<u4").tobytes()


def write_files(docs: DataFrame, vocabulary: str, path: str, added: bool = False) -> None:
    """Tokenize, count, deal by ranges of doc_id and write the coded files under ``path``."""
    spark = docs.sparkSession
    size = encoder(vocabulary, False).tokenizer.get_vocab_size()
    kind = _kind(size)
    tokens = cut(token_ids(docs, vocabulary, added), "token-ids", compression="zstd")
    table = frequency_table(tokens, size)
    freq = np.frombuffer(table, "<u4")
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id long, frequency long").coalesce(1).write.parquet(f"{path}/table")
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    schema = to_arrow_schema(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, first = TaskContext.get().partitionId(), 0, 0
        keys, sizes, parts, n = [], [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), kind)
            row = encode_block(ids, table) | {"file": file, "block": block, "first": first, "n_tokens": n, "doc_ids": keys, "sizes": sizes}
            size = CHECKPOINT * row["lanes"]
            row["crcs"] = [zlib.crc32(ids[at : at + size].astype("<u4")) for at in range(0, n, size)]
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for doc, count, ids in zip(*(batch.column(c) for c in ("doc_id", "n_tokens", "ids")), strict=True):
                keys.append(doc.as_py())
                sizes.append(count.as_py())
                parts.append(ids.as_py())
                n += sizes[-1]
                if n >= BLOCK:
                    yield close()
                    block, first = block + 1, first + n
                    keys, sizes, parts, n = [], [], [], 0
        if keys:
            yield close()

    # rows that repeat in full are alike, so they may be dealt out by any number
    order = ["doc_id", "crc32", "n_tokens", "row"]
    ordered = tokens.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-total // FILE)), *order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str, vocabulary_size: int) -> bytes:
    freq = np.zeros(vocabulary_size, np.uint32)
    for row in spark.read.parquet(f"{path}/table").collect():  # one row per id of the vocabulary at most
        freq[row["id"]] = row["frequency"]
    return freq.astype("<u4").tobytes()


def _fragments(sections: DataFrame, table: bytes, with_ids: bool) -> DataFrame:
    """The part of each document in each section: its ids' checksum, and the ids if asked for."""
    names = FRAGMENTS.names

    def run(*columns: pa.Array) -> dict[str, list]:
        out: dict[str, list] = {f: [] for f in names}
        for values in zip(*columns, strict=True):
            own = {c: v.as_py() for c, v in zip(SECTION.names, values, strict=True)}
            ids = memoryview(decode_section(own["states"], own["words"], own["n_tokens"], own["lanes"], table).astype("<u4", copy=False)).cast("B")
            if zlib.crc32(ids) != own["crc32"]:
                raise ValueError(f"section {own['section']} of block {own['block']} of file {own['file']} is damaged")
            ends = np.cumsum(own["sizes"])
            low = own["section"] * CHECKPOINT * own["lanes"]
            k, high = int(np.searchsorted(ends, low, "right")), low + own["n_tokens"]
            while k < len(ends) and (begin := int(ends[k]) - own["sizes"][k]) < high:
                a, b = max(begin, low) - low, min(int(ends[k]), high) - low
                part = ids[4 * a : 4 * b]
                row = (own["file"], own["doc_ids"][k], own["first"] + begin, own["sizes"][k], own["section"], b - a, zlib.crc32(part), bytes(part) if with_ids else None)
                for c, v in zip(names, row, strict=True):
                    out[c].append(v)
                k += 1
        return out

    return map_rows(sections, SECTION.names, run, FRAGMENTS, rows=4)


def read_files(spark: SparkSession, path: str, vocabulary: str, with_ids: bool = True) -> DataFrame:
    """Decode the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids (little-endian, 32 bits)."""
    size = encoder(vocabulary, False).tokenizer.get_vocab_size()
    table = read_table(spark, path, size)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    k, lanes, wide = F.col("section"), F.col("lanes"), F.col("lanes") * CHECKPOINT
    at = lambda i: F.when(i == 0, 0).otherwise(4 * F.get("check_words", i - 1)).cast("int")
    last = k == F.size("check_words")
    begin = at(k)
    upto = F.when(last, F.octet_length("words")).otherwise(4 * F.get("check_words", k)).cast("int")
    dealt = blocks.withColumn("section", F.explode(F.sequence(F.lit(0), F.size("check_words")))).select(
        "file", "block", "section", "first", F.least(wide.cast("long"), F.col("n_tokens") - k * wide).alias("n_tokens"), "doc_ids", "sizes", "lanes",
        F.when(k == 0, F.col("states")).otherwise(F.substring("check_states", (k - 1) * 8 * lanes + 1, 8 * lanes)).alias("states"),
        F.substring("words", begin + 1, upto - begin).alias("words"), F.get("crcs", k).alias("crc32"),
    )
    parts = _fragments(dealt, table, with_ids)
    if not with_ids:
        parts = cut(parts, "fragments")  # read twice below; without ids a row is short, and sections are decoded once
    whole = parts.where("n = n_tokens").select("file", "doc_id", "place", "n_tokens", "crc32", "ids")
    # of each section the first and the last document at most are in fragments
    several = parts.where("n < n_tokens").groupBy("file", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("section", "n", "crc32", "ids"))).alias("parts")
    )
    schema = StructType([f for f in FRAGMENTS.fields if f.name not in ("section", "n")])

    def run(files: pa.Array, docs: pa.Array, places: pa.Array, sizes: pa.Array, lists: pa.Array) -> dict[str, list]:
        out: dict[str, list] = {"file": files, "doc_id": docs, "place": places, "n_tokens": sizes, "crc32": [], "ids": []}
        for own in lists:
            crc, own = 0, own.as_py()
            for p in own:
                crc = joined_crc(crc, p["crc32"], 4 * p["n"])
            out["crc32"].append(crc)
            out["ids"].append(b"".join(p["ids"] for p in own) if with_ids else None)
        return out

    rows = whole.unionByName(map_rows(several, ["file", "doc_id", "place", "n_tokens", "parts"], run, schema, rows=16))
    # One row per file, of FILE ids each, stands in this window; the rows are counted before they are broadcast.
    files = blocks.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    begin = cut(files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("begin")), "file-starts")
    begin = F.broadcast(begin) if begin.count() <= FEW_FILES else begin
    found = rows.join(begin, "file").select("doc_id", (F.col("begin") + F.col("place")).alias("start"), "n_tokens", F.col("crc32").alias("ids_crc32"), "ids")
    return found if with_ids else found.drop("ids")


def round_trip(docs: DataFrame, vocabulary: str, added: bool = False, with_ids: bool = True) -> DataFrame:
    """Write ``docs`` to files in the shared folder and decode them again. added: as in ``packing.pack_documents``."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/rans-{uuid.uuid4().hex}"
    write_files(docs, vocabulary, path, added)
    return read_files(spark, path, vocabulary, with_ids)
