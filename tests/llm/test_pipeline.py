"""The stages in order, each on what the one before kept."""

from __future__ import annotations

import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
from helpers import frame, hard_rows, prose
from test_documents import plain_spans
from test_groups import plain_components
from tokenizers import Tokenizer

from tallyframe.llm import byte_cnn, mixing, queries


def test_stages(spark, tmp_path):
    junk = [" ".join(w + "$$$" for w in prose(70, i).split()) for i in range(500, 540)]
    texts = [prose(60 + i % 90, i) for i in range(150)]
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(texts)] + [(1000 + i, t, "s0") for i, t in enumerate(junk)]
    rows += [(2000 + i, texts[i], "s1") for i in range(20)] + [(3000, texts[5] + " write to jo@x.example.org", "s2"), (3001, None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1) for i in range(150)] + [(1000 + i, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out-{name.split()[0]}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/out-{name.split()[0]}")
        seen.append(docs.collect())
    good, first, masked, mixed, packed = seen
    assert sum(r["doc_id"] in range(1000, 1040) for r in good) <= 1 and sum(r["doc_id"] < 150 for r in good if r["doc_id"] is not None) >= 148
    assert not {r["doc_id"] for r in first} & set(range(2000, 2020)) and len(first) < len(good)
    assert len(masked) == len(first) and not any("@" in (r["text"] or "") for r in masked)
    sizes = sum(len((r["text"] or "").split()) for r in masked)
    assert abs(sum(len((r["text"] or "").split()) for r in mixed) - 1.5 * sizes) < 0.2 * sizes
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed}
    assert sum(r["length"] for r in packed if r["piece"] == 0) > 0


def through(spark, docs, labels, folder):
    """The rows of each stage; all but the last must keep the columns of ``docs``."""
    labels.write.parquet(f"{folder}/labels.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(folder))
        out.write.parquet(f"{folder}/{k}")
        assert out.columns == columns or k == len(corpus_pipeline.STAGES) - 1
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
        seen.append(docs.collect())
    return seen


def test_stages_without_documents(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert through(spark, frame(spark, hard_rows()).limit(0), labels, tmp_path) == [[]] * 5


def test_stages_on_hard_rows_and_clashing_columns_without_labels(spark, tmp_path):
    clashing = "gone_id mix times threshold label set_key piece hash taken component_id".split()
    docs = frame(spark, hard_rows()).selectExpr("*", *(f"doc_id AS {c}" for c in clashing))
    good, first, masked, mixed, packed = through(spark, docs, spark.createDataFrame([], "doc_id long, quality int"), tmp_path)
    # nothing to learn from: every score is 0.5, so all stay; of 1 and 2, and of the two rows of 7, see keep_first
    assert len(good) == len(hard_rows()) and 2 not in {r["doc_id"] for r in first} and {r["doc_id"] for r in good} - {r["doc_id"] for r in first} == {2}
    assert all(r["gone_id"] == r["doc_id"] and r["mix"] == r["doc_id"] for r in mixed)
    assert not any("a.b@c.example.org" in (r["text"] or "") for r in masked) and sorted(r["doc_id"] or 0 for r in masked) == sorted(r["doc_id"] or 0 for r in first)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed} and all(0 < r["length"] <= 1024 for r in packed)


def test_every_operator_is_registered():
    from __spark_entry__ import queries as every

    names = {n.split("_")[0] for n in every()}
    assert {f"op{n}" for n in range(1, 14)} <= names and "pipeline" in every()
    assert zlib.crc32(b"1") and set(queries.ORACLES) <= set(queries.QUERIES)


def test_each_stage_against_a_plain_version(spark, tmp_path):
    base = prose(90, 4).split(" ")
    edited = " ".join([*base[:40], "changed", *base[41:]])
    rows = [(i, prose(55 + 3 * i, i), f"s{i % 3}") for i in range(40)] + [(100 + i, " ".join(base), "s1") for i in range(6)] + [(110, edited, "s2"), (111, edited, None), (None, edited, "s0"), (None, " ".join(base), "s0")]
    rows += [(120, "call +1 (555) 010-9999 or mail a.b@c.example.org\n" + prose(60, 90), "s0"), (121, "4111 1111 1111 1111 and 10.20.30.40 " + prose(60, 91), "s2"), (122, "x" * 3000 + " <|endoftext|> " + prose(2000, 92), "s1")]
    rows += [(130 + i, "", "blank") for i in range(5)] + [(140, "one two", "blank"), (141, None, "blank"), (7, rows[7][1], "s1"), (7, rows[7][1], "s1"), (8, prose(60, 93), "s2")]
    rows += [(200 + i, " ".join(w + "$$$" for w in prose(70, 700 + i).split()), "s0") for i in range(30)]
    docs, labels = frame(spark, rows), spark.createDataFrame([(i, 1) for i in range(40)] + [(200 + i, 0) for i in range(30)], "doc_id long, quality int")
    good, first, masked, mixed, packed = through(spark, docs, labels, tmp_path)
    kind = lambda found: Counter((r["doc_id"], r["text"], r["source"]) for r in found)

    scores = byte_cnn.classify(docs, labels).collect()
    rejected = {r["doc_id"] for r in scores if r["predicted"] == 0 and r["doc_id"] is not None}
    assert kind(good) == Counter(r for r in rows if r[0] not in rejected) and rejected >= set(range(203, 230)) and not rejected & set(range(40))

    number = lambda r: 10**9 + len(r["text"] or "") if r["doc_id"] is None else r["doc_id"]
    root = plain_components([(number(r), r["text"], None) for r in good])
    kept = {(r["doc_id"], r["text"]) for r in good if root[number(r)] == number(r)}
    assert Counter((r["doc_id"], r["text"]) for r in first) == Counter(kept)
    assert {r["doc_id"] for r in first} & {100, 101, 105, 110, 111, None} == {100}

    for before, after in zip(*(sorted(x, key=lambda r: (r["doc_id"], r["source"] or "", len(r["text"] or ""))) for x in (first, masked)), strict=True):
        text = before["text"] or ""
        spans = [tuple(map(int, s.split(":")[1:])) for s in plain_spans(text)]
        assert all(text[a:b] not in after["text"] for a, b in spans)
        if not any(c in "0123456789@" for c in text):
            assert after["text"] == before["text"]
    by_id = {r["doc_id"]: r["text"] for r in masked}
    assert by_id[120].startswith("call <PHONE> or mail <EMAIL>\n") and by_id[121].startswith("<CARD> and <IP> ")

    duck = duckdb.connect()
    documents = pd.DataFrame([(r["doc_id"], r["text"], r["source"]) for r in masked], columns=["doc_id", "text", "source"])  # noqa: F841
    duck.sql("create table documents as select doc_id::bigint doc_id, text::varchar text, source::varchar source from documents")
    times = {i: taken // size for i, size, taken in duck.sql(f"select doc_id, size, taken from ({mixing.MIX_ORACLE})").fetchall() if size}
    got = Counter(r["doc_id"] for r in mixed)
    per_id = Counter(r["doc_id"] for r in masked)
    assert {i: n for i, n in got.items() if i in times and per_id[i] == 1} == {i: n for i, n in times.items() if n and per_id[i] == 1}
    assert max(got[i] for i in range(130, 135)) <= 2 and {r["text"] for r in mixed} <= {r["text"] for r in masked}

    plain, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for r in mixed:
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        at, upto = 0, len(ids) % 1024 or min(len(ids), 1024)
        while at < len(ids):
            want[r["doc_id"], at, upto - at, zlib.crc32(np.array(ids[at:upto], "<u4").tobytes())] += 1
            at, upto = upto, upto + 1024
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024 and len(fill) <= -(-sum(fill.values()) // 1024) + 1
