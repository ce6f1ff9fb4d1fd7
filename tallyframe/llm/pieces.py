"""Token counts and ids by a sentencepiece BPE file, with a shortcut for pre-tokens that are one token.

The library turns blanks into U+2581, puts one before the text and merges over the whole of it. Offline, from the vocabulary
alone, ``Pieces`` proves what makes shorter work exact:

* No piece has another sign before a U+2581, so no merge reaches over such a place; none but a single byte holds a line
  feed, and none an ASCII sign behind a letter, so none reaches over these. A text is therefore cut there into pre-tokens
  (blanks and the signs after them, line feeds, and the signs that end a Latin word), and its tokens are those of its
  pre-tokens. A vocabulary that fails this is refused.
* Each vocabulary string is encoded alone, as a pre-token, by the library. Those that give just their own id are ``whole``.

Pre-tokens that are ``whole`` count one each without any merging; the others are merged by the library, each distinct
one once while a worker keeps it. Texts with runs of blanks, blanks at an end or U+2581 are cut by a regular expression, the
others by Arrow (``tokens.Encoder``); the distinct pre-tokens of a slice are counted by numpy.

Defined results: a null or empty text has no bytes and no tokens; strings of special pieces (``<s>``) are ordinary text, as
by default; a null doc_id is kept; repeated rows count each; an empty table gives no rows; other columns are ignored. A
pre-token of any length is merged whole, with the library's memory for it (about 100 bytes a character).
"""

from __future__ import annotations

import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .base import map_rows
from .tokens import _UNEVEN, KEPT, SLICE, Encoder, _Words, slices

BLANK = "▁"
LIMIT = 4096
_PRE_TOKEN = re.compile(rf"{BLANK}+[^{BLANK}\n]*|\n|[^{BLANK}\n]+")

COUNTS = StructType([StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])


class Pieces:
    """A sentencepiece file with what is proved about its vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(len(self.library))]
        own = [i for i in range(len(names)) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i))]
        signs = lambda name: any(a.isalpha() and b in string.punctuation for a, b in zip(name, name[1:], strict=False))
        if any(BLANK in names[i].lstrip(BLANK) or "\n" in names[i] or signs(names[i]) for i in own):
            raise ValueError(f"pieces of {path} reach over blanks, line feeds or signs after letters, so texts can't be cut there")
        #: Vocabulary strings that are one token as pre-tokens, with their ids.
        self.whole = {names[i]: i for i, ids in zip(own, self.merge([names[i] for i in own]), strict=True) if ids == [i]}
        #: The bytes that each id stands for.
        self.bytes_of = [bytes([int(n[3:5], 16)]) if self.library.is_byte(i) else n.replace(BLANK, " ").encode() for i, n in enumerate(names)]

    def merge(self, pre_tokens: list[str]) -> list[list[int]]:
        """Ids of each pre-token by the library; the line feed beside it keeps the library from adding or dropping a blank."""
        ids = self.library.encode([p[1:] + "\n" if p.startswith(BLANK) else "\n" + p for p in pre_tokens], num_threads=1)
        return [i[:-1] if p.startswith(BLANK) else i[2:] for p, i in zip(pre_tokens, ids, strict=True)]


class _Ids(_Words):
    """Pre-token -> its number; see ``_Words``."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.start()

    def prepare(self, texts: list[str]) -> None:
        """Merge what is neither known nor whole, in one call of the library."""
        new = [t for t in dict.fromkeys(texts) if t and t not in self and t not in self.pieces.whole]
        for text, ids in zip(new, self.pieces.merge(new), strict=True):
            self.add(text, ids)

    def __missing__(self, text: str) -> int:
        whole = self.pieces.whole.get(text)
        return self.add(text, [whole] if whole is not None else self.pieces.merge([text])[0] if text else [])


class PieceEncoder(Encoder):
    """Ids and counts by a sentencepiece file, with the parts of ``tokens.Encoder``."""

    blank = BLANK

    def __init__(self, path: str, kept: int = KEPT, size: int = SLICE):
        self.pieces, self.spaces, self.lead, self.kept, self.size = Pieces(path), True, BLANK, kept, size
        self.words = _Ids(self.pieces)

    def _set_apart(self, texts: pa.Array) -> tuple[pa.Array, dict[int, list[int]]]:
        flags = pc.or_(pc.match_substring_regex(texts, _UNEVEN), pc.match_substring(texts, BLANK))
        odd = {}
        for i in np.flatnonzero(flags.to_numpy(zero_copy_only=False)):
            found = _PRE_TOKEN.findall(BLANK + texts[i].as_py().replace(" ", BLANK))
            self.words.prepare(found)
            odd[i] = [x for p in found for x in self.words.of(p)]
        return pc.if_else(flags, pa.scalar("", pa.large_string()), texts), odd


@lru_cache(maxsize=1)
def piece_encoder(path: str, kept: int = KEPT, size: int = SLICE) -> PieceEncoder:
    """One per worker process and file."""
    return PieceEncoder(path, kept, size)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) for every row of ``docs`` (doc_id, text)."""

    def run(doc_ids: pa.Array, texts: pa.Array) -> dict[str, list]:
        counter, texts = piece_encoder(path), pc.fill_null(texts, "")
        n = [np.zeros(0, np.int64), *map(counter.count, slices(texts, counter.size))]
        return {"doc_id": doc_ids, "n_bytes": pc.binary_length(texts), "n_tokens": np.concatenate(n)}

    return map_rows(docs, ["doc_id", "text"], run, COUNTS).withColumn("over_limit", F.col("n_tokens") > limit)
