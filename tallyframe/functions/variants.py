"""Field paths of JSON texts without Python: texts become variants, which are opened level by level in one chain of generators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lists within lists (and lists as fields) that a path may go through.
LAYERS = 4


def field_paths(df: DataFrame, keys: list[str], text: str, depth: int = 3, first: int = 20, layers: int = LAYERS) -> DataFrame:
    """``keys`` and ``path``: the distinct paths of fields down to ``depth`` in each row's text; a list's elements (the ``first`` of them) are ``path[]``.

    As ``jsons.field_paths``, for texts that ``parse_json`` takes: no text, and one that isn't JSON or names a field twice, has no paths. Each
    text is parsed once. A text with more than ``layers`` lists above one of its paths stops the job, so that no path is lost unseen.
    """
    spark = df.sparkSession
    named = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, named, strict=True)), F.try_parse_json(text).alias("_v"), F.lit("").alias("_at"), F.lit(depth).alias("_left"), F.array().cast("array<string>").alias("_found"))
    for _ in range(depth + layers):
        # of what isn't opened any more the row stays, with what it has found
        opened = spark.sql(
            f"SELECT {', '.join(['t.' + n for n in named])}, e.pos AS _pos, e.key AS _name, e.value AS _v, _at, _left, _found FROM {{rows}} t, LATERAL variant_explode_outer(CASE WHEN _left > 0 THEN _v END) e", rows=rows
        )
        field, element = F.col("_name").isNotNull(), F.col("_name").isNull() & F.col("_pos").isNotNull()
        path = F.when(F.col("_at") == "", F.col("_name")).otherwise(F.concat_ws(".", "_at", "_name"))
        opened = opened.where(~element | (F.col("_pos") < first))
        rows = opened.select(
            *named, "_v", F.when(field, path).when(element, F.concat("_at", F.lit("[]"))).otherwise(F.col("_at")).alias("_at"), F.when(field, F.col("_left") - 1).otherwise(F.col("_left")).alias("_left"),
            F.when(field, F.array_append("_found", path)).otherwise(F.col("_found")).alias("_found"),
        )
    more = (F.col("_left") > 0) & F.coalesce(F.schema_of_variant("_v").rlike("^(ARRAY|OBJECT)"), F.lit(False))
    whole = F.when(more, F.raise_error(F.concat(F.lit(f"more than {layers} lists above "), F.col("_at"))).cast("array<string>")).otherwise(F.col("_found"))
    out = rows.select(*named, F.explode(whole).alias("path")).distinct()
    return out.select(*(F.col(n).alias(k) for k, n in zip(keys, named, strict=True)), "path")
