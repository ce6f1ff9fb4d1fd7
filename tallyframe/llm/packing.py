"""Best-fit packing of tokenized documents into sequences, improved by swap-based local search.

A document's ids are those of its text and an end id. Only longer documents are cut, into full pieces; the first
piece takes what is over. Full pieces are sequences of their own. The short pieces are dealt evenly into groups of
about ``GROUP`` pieces; in each, best fit in decreasing length opens the bins, and local search then empties bins:
from each underfull bin, emptiest first, a piece moves to a bin with room for it, or is exchanged for a shorter piece or for
two shorter pieces of another underfull bin, until no bin has such a step left or the bins are as few as their fill allows.
Each step increases the sum of squared fills, so the search ends. A group loses less
than one bin to its border, about a thousandth of its bins.

Defined results: a null or empty text is one piece of the end id alone; a null doc_id is packed like any other; rows
that repeat are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .base import cut
from .tokens import KEPT, SLICE, encoder

CAPACITY = 1024
END_ID = 2
#: Short pieces a group holds about: enough that the last bin of a group doesn't count, few enough for any task.
GROUP = 20_000

PIECES = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("piece", IntegerType()),
        StructField("start", LongType()),
        StructField("length", LongType()),
        StructField("ids_crc32", LongType()),
    ]
)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, added: bool = False, lean: bool = False) -> DataFrame:
    """One row per piece of every document: where it starts in the document's ids, its length and checksum.

    lean: workers take half as much text at once, keep half as many words, and none from one task to the next.
    """
    schema = to_arrow_schema(PIECES)
    kept, size = (KEPT // 2, SLICE // 2) if lean else (KEPT, SLICE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, True, kept, size, added)
        for batch in batches:
            done = 0
            for ids, ends in own.batches(batch.column(1)):  # a slice at a time, to hold few ids at once
                whole = memoryview(np.insert(ids, ends[1:], END_ID).astype("<u4", copy=False)).cast("B")
                ends = ends + np.arange(len(ends))
                length_of = np.diff(ends)
                number = -(-length_of // capacity)
                doc = np.repeat(np.arange(len(length_of)), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                first = length_of - (number - 1) * capacity  # what is over after full pieces
                start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[doc])
                begin = (4 * (ends[doc] + start)).tolist()
                crc = [zlib.crc32(whole[a : a + n]) for a, n in zip(begin, (4 * length).tolist(), strict=True)]
                keys = batch.column(0).take(pa.array(done + doc))
                done += len(length_of)
                columns = [keys, *(pa.array(c, f.type) for c, f in zip((piece.astype(np.int32), start, length, crc), list(schema)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
            pa.default_memory_pool().release_unused()
        if lean:
            own.forget()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of places in ``lengths``: each piece, longest first, goes where it leaves least room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        if fits := rooms >> size:
            room = size + (fits & -fits).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, own = capacity, len(bins)
            bins.append([])
        bins[own].append(int(i))
        if left := room - size:
            by_room.setdefault(left, []).append(own)
            rooms |= 1 << left
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty bins by moves, one-for-one and two-for-one exchanges that increase the sum of squared fills, until none is left.

    Underfull bins are indexed by room, and by room for each sum that one or two of their pieces have.
    """
    size = lengths.tolist()
    room = [capacity - sum(size[i] for i in b) for b in bins]
    least = -(-sum(size) // capacity)
    live = sum(1 for b in bins if b)
    where: dict[tuple[int, int], dict[int, None]] = {}  # sum (0: any) and room -> bins
    rooms = [0] * (capacity + 1)  # sum -> bit r is set if a bin has it and room r
    sums: dict[int, list[int]] = {}  # of the indexed bins

    def show(k: int) -> None:
        if not 0 < room[k] < capacity:
            return
        one = both = 0
        for i in bins[k]:
            both |= one << size[i]
            one |= 1 << size[i]
        bits, sums[k] = one | both | 1, []
        while bits:
            v = (bits & -bits).bit_length() - 1
            bits &= bits - 1
            sums[k].append(v)
            where.setdefault((v, room[k]), {})[k] = None
            rooms[v] |= 1 << room[k]

    def hide(k: int) -> None:
        for v in sums.pop(k, ()):
            own = where[v, room[k]]
            del own[k]
            if not own:
                del where[v, room[k]]
                rooms[v] &= ~(1 << room[k])

    def step(e: int) -> int:
        """One improving exchange out of bin ``e``, which is not indexed: the bin it was made with, or -1."""
        for x in sorted(bins[e], key=size.__getitem__, reverse=True):
            out: list[int] = []
            if fits := rooms[0] >> size[x]:
                r = size[x] + (fits & -fits).bit_length() - 1
                if capacity - r + size[x] > capacity - room[e]:  # a move, to the fullest bin that has room
                    b = next(iter(where[0, r]))
                    hide(b)
                    bins[e].remove(x)
                    bins[b].append(x)
                    room[b] -= size[x]
                    room[e] += size[x]
                    show(b)
                    return b
            found = (room[e] + 1, 0)  # the fullest bin, at least as full as this one, that can give less than x and then has room for it
            for v in range(size[x] - 1, max(0, size[x] - 1 - room[e]), -1):
                if fits := rooms[v] >> (size[x] - v):
                    found = min(found, (size[x] - v + (fits & -fits).bit_length() - 1, v))
            if found[0] > room[e]:
                continue
            b = next(iter(where[found[1], found[0]]))
            need = size[x] - room[b]  # what must leave b
            inside = sorted(bins[b], key=size.__getitem__)
            sizes = [size[i] for i in inside]
            at = bisect_left(sizes, need)
            out = [inside[at]] if at < len(inside) and sizes[at] < size[x] else []
            if not out:
                low, high, best = 0, len(inside) - 1, size[x]
                while low < high:
                    both = sizes[low] + sizes[high]
                    if both < need:
                        low += 1
                    else:
                        if both < best:
                            best, out = both, [inside[low], inside[high]]
                        high -= 1
            gone = sum(size[i] for i in out)
            hide(b)
            bins[e].remove(x)
            bins[b] = [i for i in bins[b] if i not in out] + [x]
            bins[e] += out
            room[b] -= size[x] - gone
            room[e] += size[x] - gone
            show(b)
            return b
        return -1

    for k in range(len(bins)):
        show(k)
    changed = True
    while changed and live > least:  # a bin that no step leads out of is tried again only after another step was made
        changed = False
        for e in sorted(sums, key=lambda k: (-room[k], k)):
            if live == least:
                break
            if e not in sums:  # full or empty by now
                continue
            hide(e)
            while bins[e] and step(e) >= 0:
                changed = True
            show(e)
            live -= not bins[e]
    return [b for b in bins if b]


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Give every piece its sequence and its place there. ``pieces`` must be a written table (it is read twice)."""
    short = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group))
    whole = pieces.where(F.col("length") >= capacity).select(
        *PIECES.names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    schema = StructType([*PIECES.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        order = np.array([i for b in bins for i in b])
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.concatenate([[True], number[1:] != number[:-1]])
        out = rows.iloc[order].drop(columns="bin_group")
        return out.assign(sequence_id=(int(key[0]) << 32) + number, offset=before - before[first][number])

    dealt = short.withColumn("bin_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("bin_group").applyInPandas(run, schema).unionByName(whole)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, added: bool = False, lean: bool = False) -> DataFrame:
    """added: whether strings of added tokens in a text give these tokens' ids, as the library does by default. lean: as in ``token_pieces``."""
    return pack(cut(token_pieces(docs, vocabulary, capacity, added, lean), "pieces"), capacity)
