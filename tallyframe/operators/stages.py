"""Tables written between the steps of a job that goes on from its own results."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which a cluster must set; a session in one JVM gets one of its own where it is unset."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        told = tempfile.mkdtemp(prefix="spark-stages-")
        spark.conf.set("spark.checkpoint.dir", told)
    return told.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table of the shared folder: computed once, whole after the loss of executors, its lineage cut."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
