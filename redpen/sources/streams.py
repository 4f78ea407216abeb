"""Streaming sources."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def stream_table(
    spark: SparkSession, path: str, schema: StructType, max_files: int | None = None
) -> DataFrame:
    """A parquet folder or file as a stream. The schema is given, never inferred."""
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # As a pattern the path may name a single file as well as a folder.
    return reader.load(f"{path[:-1]}[{path[-1]}]")
