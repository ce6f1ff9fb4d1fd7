"""Token counts and alignments against the unmodified libraries."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from helpers import frame, hard_rows, prose
from tokenizers import Tokenizer

from tallyframe.llm import alignment, pieces
from tallyframe.llm.tokens import Encoder, slices

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(n: int) -> list[str | None]:
    r = random.Random(5)
    parts = [*"aeinorst  \n\t.,'\"09▁éßİ日本🙂\x00\x01\x1c\xa0", "<s>", "</s>", "  ", "the ", "ing ", "\n\n", " \n", "<|endoftext|>", "<0x41>", "Don't ", "x" * 30, "word. ", "é"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(50))) for _ in range(n)] + [None, "", " ", "\n", "▁", " ▁ ", "\n a", "\x01", "\x01 ", "a \x01b"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_encoders_give_the_libraries_ids(libraries):
    a, b = libraries
    texts = odd_texts(4000)
    pairs = [(Encoder(BYTES, True, kept=500, lead=True), lambda t: a.encode(" " + t, add_special_tokens=False).ids if t else []), (pieces.PieceEncoder(PIECES, kept=500), b.encode)]
    for encoder, plain in pairs:
        at = 0
        for part in slices(pa.array(texts), 3000):
            counts = encoder.count(part).tolist()
            ids, ends = encoder.encode(part)
            for x, y, n in zip(ends, ends[1:], counts, strict=False):
                assert ids[x:y].tolist() == plain(texts[at] or "") and n == y - x, texts[at]
                at += 1
        assert at == len(texts)


def test_whole_strings_are_one_token(libraries):
    _, b = libraries
    own = pieces.Pieces(PIECES)
    assert len(own.whole) > 30_000
    for name, number in list(own.whole.items())[::37]:
        assert b.encode(name[1:].replace("▁", " ")) == [number] if name.startswith("▁") else b.encode("\n" + name)[2:] == [number]


def test_counts_of_every_document(spark, libraries):
    _, b = libraries
    rows = [*hard_rows(), *((100 + i, t, "o") for i, t in enumerate(odd_texts(300))), (900, prose(4000, 3), "a")]
    got = pieces.count_tokens(frame(spark, rows), PIECES).collect()
    want = Counter((i, len((t or "").encode()), len(b.encode(t or "")), len(b.encode(t or "")) > 4096) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert any(r["over_limit"] for r in got) and got[0].asDict().keys() == {"doc_id", "n_bytes", "n_tokens", "over_limit"}
    assert pieces.count_tokens(frame(spark, rows).where("false"), PIECES).collect() == []


def plain_alignment(rows, a, b):
    """All links of each document by comparing every pair of tokens, and the documents of each pair of ids."""
    table = alignment.byte_level_bytes(a)
    pieces_of = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, holders, best = [], Counter(), defaultdict(int)
    for doc, text, _ in rows:
        whole = (" " + (text or "")).encode()
        sides = [[(i, table[i]) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, pieces_of(i)) for i in b.encode(text)]] if text else []
        if not sides or any(b"".join(x for _, x in side) != whole for side in sides):
            found.append((doc, 0, 0, 0, [], ""))
            continue
        spans = []
        for side in sides:
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(i, j) for i, s, e in spans[0] for j, t, u in spans[1] if s < u and t < e]
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, low = [], 0
        for high in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in spans))
            low = high
        holders.update(set(links))
        found.append((doc, len(spans[0]), len(spans[1]), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    for (i, _), n in holders.items():
        best[i] = max(best[i], n)
    return Counter((doc, x, y, g, len(links), sum(holders[p] == best[p[0]] for p in links), sum(holders[p] for p in links), h) for doc, x, y, g, links, h in found)


@pytest.mark.parametrize("few", [alignment.FEW_PAIRS, 10])
def test_alignment_against_all_pairs_of_tokens(spark, libraries, few, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 4000)
    rows = [(i, t if t is None or len(t) < 3000 else t[:3000], s) for i, t, s in hard_rows()]
    rows += [(100 + i, t, "o") for i, t in enumerate(odd_texts(150))] + [(400 + i, prose(30, i), "p") for i in range(20)]
    got = alignment.align_tokens(frame(spark, rows).selectExpr("*", "1 AS pair", "2 AS row", "3 AS n_a").repartition(3), BYTES, PIECES, few)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain_alignment(rows, *libraries)
    assert alignment.align_tokens(frame(spark, rows).where("false"), BYTES, PIECES, few).collect() == []


def test_partial_counts_are_sent_when_there_are_many(spark, monkeypatch):
    monkeypatch.setattr(alignment, "GATHERED", 4)
    lists = [[1, 2], [2, 3, 12], [1, 2, 10, 11], [], [2]]
    links = spark.createDataFrame([(x,) for x in lists], "pairs array<long>").coalesce(1)
    got = {r["pair"]: (r["n"], r["top"]) for r in alignment.pair_counts(links, 10).collect()}
    assert got == {1: (2, False), 2: (4, True), 3: (1, False), 10: (1, True), 11: (1, True), 12: (1, True)}


def test_a_long_text_without_blanks_is_aligned():
    own = alignment.Aligner(BYTES, PIECES)
    text = "ab" * 20_000 + "é" * 5000
    out = own.align(pa.array([text, "", text + "▁"], pa.large_string()))
    assert out["n_a"][0] > 0 and np.asarray(out["n_links"])[1:].tolist() == [0, 0] and out["groups_sha256"][1:] == ["", ""]
