"""A training corpus from raw documents in stages, each written as Parquet and read again by the next.

The quality classifier's rejects go, one document of each group of near-duplicates stays, personal data is masked, the
sources are mixed to their target weights (a document that the mix takes twice is there twice), and what is left is
packed into sequences. Every stage works on all that the one before kept; all but the last keep the columns of documents.

A row with a null doc_id is judged by its text in the first stage, and takes part in the second under a number that its text gives. Exact copies
of a row go there too, whatever its doc_id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import byte_cnn, mixing, near_dup, packing, pii
from tallyframe.llm.base import shared_dir, table
from tallyframe.llm.queries import vocabulary

#: Rows of whole texts that a Python worker gets at once, where the session has Spark's default of 10,000: stages share their
#: workers and their executors' memory.
BATCH = "1000"
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _small_batches(spark: SparkSession) -> None:
    if spark.conf.get(ROWS, "10000") == "10000":
        spark.conf.set(ROWS, BATCH)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return byte_cnn.keep_good(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return near_dup.keep_first(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), added=True, lean=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("PII", redact_pii),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]
#: A fitted classifier and graph components can't be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        done.write.parquet(path := f"{folder}/{k}")
        docs = spark.read.schema(done.schema).parquet(path)
    return docs
