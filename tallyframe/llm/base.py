"""What the operators of this subpackage share: table reads, lineage cuts and Arrow text maps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word is a run without ASCII white space; str.split() would also cut at U+001C..1F and at Unicode spaces.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same for Java and RE2 expressions.
WORD_SQL = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``, or else the context's checkpoint folder.

    Where neither is set, a session that runs in one JVM gets a temporary folder of its own; on a cluster it is an error,
    as a machine's own folder isn't seen by the others.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        told = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", told)
    return told.rstrip("/")


def fresh_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores if ``taken`` has it in any case."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def cut(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: its work is done once and survives lost executors.

    ``options`` are the Parquet writer's, such as compression."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one key that a join may bring to one task; and keys above it that are broadcast at most (about 20 bytes each).
HEAVY, MOST_HEAVY = 256, 100_000


def heavy_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """The keys that more than HEAVY of ``rows`` (a written table) have, with ``parts``, the number of tasks to deal each to; None without any.

    No more than MOST_HEAVY keys: the limit is raised to a MOST_HEAVY-th of the rows, which fewer keys can exceed.
    """
    heavy = cut(rows.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > HEAVY) & F.col(key).isNotNull()), "heavy-keys")
    number, total = heavy.agg(F.count("*"), F.sum("n")).first()
    if not number:
        return None
    limit = HEAVY if number <= MOST_HEAVY else max(HEAVY, total // MOST_HEAVY)
    return heavy.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("parts"))


def join_keyed(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``table``, which has few rows of a key; keys with many of ``rows`` are dealt to several tasks.

    Such keys are counted first, and only they and their numbers of parts are broadcast. ``rows`` must be a written table, as it is read twice.
    """
    heavy = heavy_keys(rows, key)
    return dealt_join(rows, table, key, heavy, rows.columns, how)


def dealt_join(rows: DataFrame, table: DataFrame, key: str, heavy: DataFrame | None, by: list[str], how: str = "inner") -> DataFrame:
    """The same for keys that ``heavy_keys`` has found, in these rows or in those they come from; ``by``: columns of ``rows`` that tell them apart."""
    if heavy is None:
        return rows.join(table, key, how)
    parts, part = (fresh_name(c, [*rows.columns, *table.columns]) for c in ("parts", "part"))
    known = F.broadcast(heavy.withColumnRenamed("parts", parts))
    many = F.coalesce(F.col(parts), F.lit(1))
    left = rows.join(known, key, "left").withColumn(part, F.pmod(F.xxhash64(*by), many).cast("int")).drop(parts)
    right = table.join(known, key, "left").withColumn(part, F.explode(F.sequence(F.lit(0), many - 1))).drop(parts)
    return left.join(right, [key, part], how).drop(part)


def map_rows(df: DataFrame, columns: list[str], fn: Callable[..., dict[str, list]], schema: StructType, rows: int = 1000) -> DataFrame:
    """Give ``fn`` the named columns of ``rows`` rows at a time as Arrow arrays; it returns the output columns as lists or arrays.

    An Arrow batch may hold many long texts; only a slice of it is spread out as Python objects at a time.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn(*(part.column(i) for i in range(len(columns))))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
            pa.default_memory_pool().release_unused()

    return df.select(*columns).mapInArrow(run, schema)
