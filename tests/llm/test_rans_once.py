"""Files that are read for their digests are decoded once."""

from __future__ import annotations

import zlib

import numpy as np
from public_tokenizers import path

from tallyframe.llm import rans


def test_sections_are_decoded_once(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words {i} " * (i % 9)) for i in range(300)], "doc_id long, text string")
    vocabulary, root, seen = path("word_bpe_49k.json"), str(tmp_path / "files"), []
    rans.write_files(docs, vocabulary, root)
    monkeypatch.setattr(rans, "cut", lambda df, label, f=rans.cut, **o: seen.append(label) or f(df, label, **o))
    got = rans.read_files(spark, root, vocabulary, False)
    want = rans.read_files(spark, root, vocabulary).collect()
    assert seen.count("fragments") == 1
    assert sorted(map(tuple, got.collect())) == sorted(tuple(x)[:4] for x in want)
    assert all(x["ids_crc32"] == zlib.crc32(np.frombuffer(bytes(x["ids"]), "<u4")) for x in want)
