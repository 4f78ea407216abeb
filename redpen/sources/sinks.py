"""Writing matches, and places for intermediate tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redpen.operators.merge import nested_results


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the folder the session names in ``spark.checkpoint.dir``.

    Where that is unset, the folder lies in the session's warehouse, which all
    executors share as well. Never a machine-local temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    return f"{base}/{purpose}-{uuid.uuid4().hex}"


def write_nested(
    matches: DataFrame, path: str, keys: list[str], sentences: DataFrame | None = None,
    fmt: str = "parquet",
) -> None:
    """One row per sentence with its ordered match list; with ``sentences`` also empty lists."""
    nested = nested_results(matches, keys)
    if sentences is not None:
        empty = F.array().cast(nested.schema["matches"].dataType)
        nested = sentences.select(*keys).join(nested.select(*keys, "matches"), keys, "left")
        nested = nested.withColumn("matches", F.coalesce("matches", empty))
    nested.write.mode("overwrite").format(fmt).save(path)
