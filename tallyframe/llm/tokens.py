"""Token ids of whole texts by the ``tokenizers`` library, each distinct word encoded once while a worker keeps it.

Both vocabularies cut a text into words before they merge, and no word reaches over a cut as used here, so the ids
of a text are those of its parts in order:

* ``byte_bpe_50k.json`` (``spaces=True``): a cut before a space that a non-space follows, and around a lone line feed
  between non-spaces. Texts with runs of white space, or white space at an end, are cut by the first rule only.
* ``word_bpe_49k.json`` (``spaces=False``): white space and case are dropped, so any space or line feed is a cut.
* both: between a Latin letter and the ASCII punctuation that ends a part (letters and other signs never share a word).

A text that holds the string of an added token (``<|endoftext|>``) is encoded whole where ``added`` is set, as the library does by
default: the string becomes the token's id. Otherwise such strings are ordinary text.

The parts of a slice are split and numbered by Arrow, their end punctuation is set apart by numpy; Python sees distinct words only.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a worker keeps, about 150 bytes each; beyond, those of the last slice stay and the others go.
KEPT = 400_000
#: Texts cut at once are of about so many bytes; the arrays over their parts and ids take about ten times that.
SLICE = 3_000_000
_START = "\x01"  # stands before a part that has no space before it
_BLANK = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
_UNEVEN = rf"{_BLANK}{{2}}|\A{_BLANK}|{_BLANK}\z|{_START}"
_BEFORE_SPACE = re.compile(r"(?= \S)")
#: The first UTF-8 byte of characters that are no Latin letters of the first blocks.
_NOT_LATIN = 0xC9
#: Letters of these blocks whose lower case is more than letters (a letter and a mark): a word that ends so takes signs in.
_NOT_LETTERS_BELOW = [c for c in map(chr, range(0x250)) if c.isalpha() and not c.lower().isalpha()]


def _large(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()  # many times faster than to_pylist


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a letter: printable Latin-1 as itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def _ranges(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places begin, begin + 1, ... of each range, one range after the other, and where each starts and the last ends."""
    total = np.concatenate([[0], np.cumsum(count)])
    kind = np.int32 if max(total[-1], begin.max(initial=0)) < 1 << 30 else np.int64
    place = np.repeat((begin - total[:-1]).astype(kind), count)
    place += np.arange(total[-1], dtype=kind)
    return place, total


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of large strings, and where each begins and ends."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8), offsets


def _head_and_tail(parts: pa.Array, spaces: bool) -> tuple[pa.Array, pa.Array]:
    """Parts of Latin letters without the punctuation at their ends, and that; other parts are whole and have no tail."""
    core = pc.utf8_rtrim(parts, characters=string.punctuation)
    data, offsets = _bytes_of(core)
    letters = pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False)
    some = np.flatnonzero(offsets[1:] > offsets[:-1])
    letters[some] &= np.maximum.reduceat(data, offsets[some]) < _NOT_LATIN if len(some) else True
    for odd in () if spaces else _NOT_LETTERS_BELOW:
        letters &= ~pc.match_substring(core, odd).to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    data, offsets = _bytes_of(parts)
    cut = np.where(letters, np.diff(offsets) - size, 0)
    place, ends = _ranges(offsets[1:] - cut, cut)
    tail = pa.LargeStringArray.from_buffers(len(parts), pa.py_buffer(ends), pa.py_buffer(data[place]))
    return pc.if_else(pa.array(letters), core, parts), tail


def slices(texts: pa.Array, size: int):
    """Large strings (null: empty) of about ``size`` bytes together, or one text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    total, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size)))
        yield texts.slice(at, upto - at)
        at = upto


class _Words(dict):
    """Text of a part, with the space before it -> its number; ``ids`` from ``ends[number]`` on are its ids."""

    def __init__(self, tokenizer, spaces: bool):
        super().__init__()
        self.encode, self.merge, self.spaces = tokenizer.encode, tokenizer.model.tokenize, spaces
        self.letters = _byte_letters()
        self.start()

    def start(self) -> None:
        self.ids, self.ends = array("I"), array("q", [0])

    def add(self, text: str, ids: list[int]) -> int:
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        number = self[text] = len(self)
        return number

    def __missing__(self, text: str) -> int:
        word = text.removeprefix(" ")
        if word.isalpha() and (word.isascii() or max(word) < "ɐ") and (self.spaces or word.lower().isalpha()):
            # a single word as the vocabulary cuts them, so only its merges are left to do
            own = text if self.spaces else word.lower()
            shown = own.replace(" ", self.letters[32]) if own.isascii() else own.encode().decode("latin-1").translate(self.letters)
            return self.add(text, [t.id for t in self.merge(shown)])
        return self.add(text, self.encode(text, add_special_tokens=False).ids if text else [])

    def prepare(self, texts: list[str]) -> None:
        """Called with the texts that are looked up next."""

    def of(self, text: str) -> list[int]:
        k = self[text]
        return self.ids[self.ends[k] : self.ends[k + 1]].tolist()

    def keep(self, texts: list[str], numbers: np.ndarray) -> None:
        """Drop all but these distinct texts."""
        ends = np.array(self.ends)
        place, total = _ranges(ends[numbers], np.diff(ends)[numbers])
        self.ids, self.ends = array("I", np.array(self.ids)[place].tobytes()), array("q", total.tobytes())
        self.clear()
        self.update(zip(texts, range(len(texts)), strict=True))


class Encoder:
    blank = " "  # what stands before a part

    def __init__(self, path: str, spaces: bool, kept: int = KEPT, size: int = SLICE, added: bool = False, lead: bool = False):
        """kept and size: see KEPT and SLICE; larger ones save work and cost memory. added: whether strings of added tokens give their ids.

        lead: whether a space stands before each text that isn't empty (with ``spaces`` only)."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if not added:
            self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.spaces, self.kept, self.size, self.lead = spaces, kept, size, " " if lead else ""
        self.words = _Words(self.tokenizer, spaces)

    def _set_apart(self, texts: pa.Array) -> tuple[pa.Array, dict[int, list[int]]]:
        """Ids of the texts that can't be cut at every space; in the array they are empty."""
        odd: dict[int, list[int]] = {}
        for mark in self.added:
            flags = pc.match_substring(texts, mark)
            odd |= {i: self.words.encode(self.lead + texts[i].as_py(), add_special_tokens=False).ids for i in np.flatnonzero(flags.to_numpy(zero_copy_only=False))}
            texts = pc.if_else(flags, _large(""), texts)
        if self.spaces:
            flags = pc.match_substring_regex(texts, _UNEVEN)
            for i in np.flatnonzero(flags.to_numpy(zero_copy_only=False)):
                odd[i] = [x for piece in _BEFORE_SPACE.split(self.lead + texts[i].as_py()) if piece for x in self.words.of(piece)]
            texts = pc.if_else(flags, _large(""), texts)
        return texts, odd

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, list[int]], list[str], np.ndarray]:
        """Of a slice of large strings: where each text's parts begin and end; their numbers; of each distinct part the two numbers
        that its head and its tail have in ``words``; the ids of texts that are set apart; and the distinct heads and tails with these numbers."""
        texts, odd = self._set_apart(texts)
        if self.spaces:
            texts = pc.replace_substring(texts, "\n", f" \n {_START}")
            texts = texts if self.lead else pc.binary_join_element_wise(_large(_START), texts, _large(""))
        else:
            texts = pc.replace_substring(texts, "\n", " ")
        lists = pc.split_pattern(texts, " ")
        coded = lists.values.dictionary_encode()
        parts = coded.dictionary
        if self.spaces:  # an empty part is an empty text here
            bare = pc.or_(pc.or_(pc.starts_with(parts, _START), pc.equal(parts, _large("\n"))), pc.equal(parts, _large("")))
            parts = pc.utf8_ltrim(parts, characters=_START)
        head, tail = _head_and_tail(parts, self.spaces)
        if self.spaces:
            head = pc.binary_join_element_wise(pc.if_else(bare, _large(""), _large(self.blank)), head, _large(""))
        heads, tails = head.dictionary_encode(), tail.dictionary_encode()
        texts_of = [*_strings(heads.dictionary), *_strings(tails.dictionary)]
        self.words.prepare(texts_of)
        number = np.fromiter(map(self.words.__getitem__, texts_of), np.int64, len(texts_of))
        two = np.stack([number[heads.indices.to_numpy()], number[len(heads.dictionary) + tails.indices.to_numpy()]], axis=1).ravel()
        return lists.offsets.to_numpy(), coded.indices.to_numpy(), two, odd, texts_of, number

    def _trim(self, texts_of: list[str], number: np.ndarray) -> None:
        """Keep the words of this slice only, where there are too many."""
        if len(self.words) > self.kept:
            own = dict(zip(texts_of, number.tolist(), strict=True))
            self.words.keep(list(own), np.fromiter(own.values(), np.int64, len(own)))

    def count(self, texts: pa.Array) -> np.ndarray:
        """Numbers of ids of a slice of large strings."""
        upto, part, two, odd, *words = self._cut(texts)
        each = np.diff(np.array(self.words.ends))[two].reshape(-1, 2).sum(axis=1)
        n = np.diff(np.concatenate([[0], np.cumsum(each[part])])[upto])
        for i, ids in odd.items():
            n[i] = len(ids)
        self._trim(*words)
        return n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice of large strings, and where each text's begin and end."""
        upto, part, two, odd, *words = self._cut(texts)
        ends = np.array(self.words.ends)
        # a distinct part is the ids of its head and those of its tail
        place, total = _ranges(ends[two], np.diff(ends)[two])
        blob, ends = np.frombuffer(self.words.ids, np.uint32)[place], total[::2]
        place, total = _ranges(ends[part], np.diff(ends)[part])
        ids, ends = blob[place], total[upto]
        if odd:
            rows = [np.array(odd[i], np.uint32) if i in odd else ids[a:b] for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
            ids, ends = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        self._trim(*words)
        return ids, ends

    def forget(self) -> None:
        """Keep no words."""
        self.words.keep([], np.zeros(0, np.int64))

    def batches(self, texts: pa.Array):
        """For slices of the texts (null: empty): the ids of all of them, and where each text's ids begin and end."""
        yield from map(self.encode, slices(texts, self.size))


@lru_cache(maxsize=1)
def encoder(path: str, spaces: bool, kept: int = KEPT, size: int = SLICE, added: bool = False) -> Encoder:
    """One per worker process and vocabulary file."""
    return Encoder(path, spaces, kept, size, added)
