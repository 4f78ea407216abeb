"""Reading documents, sentences and rewrite pairs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_DDL = "doc_id BIGINT, text STRING, lang STRING, source STRING"
SENTENCE_DDL = "doc_id BIGINT, sent_idx INT, text STRING"
REWRITE_DDL = "doc_id BIGINT, sent_idx INT, corrector_idx INT, original STRING, corrected STRING"


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Read only the columns of ``schema`` from parquet or JSON lines.

    Missing columns are null. Parquet columns are cast, so integer widths of the
    file do not matter.
    """
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(schema)
    if fmt == "json":
        return spark.read.schema(wanted).json(path)
    if fmt != "parquet":
        raise ValueError(f"Unknown format: {fmt}")
    df = spark.read.parquet(path)
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in wanted
        ]
    )


def read_documents(
    spark: SparkSession, path: str, fmt: str = "parquet", partitions: int | None = None, language: str | None = None
) -> DataFrame:
    """Documents from parquet, JSON lines, or whole text files (id from the path).

    ``partitions`` deals the rows out by id, for inputs in too few files; large tables need
    no such shuffle. ``language`` is that of text files.
    """
    if partitions is not None:
        return read_documents(spark, path, fmt, language=language).repartition(partitions, "doc_id")
    if fmt == "text":
        return spark.read.text(path, wholetext=True).select(
            F.xxhash64(F.input_file_name()).alias("doc_id"),
            F.col("value").alias("text"),
            F.lit(language).cast("string").alias("lang"),
            F.input_file_name().alias("source"),
        )
    return read_table(spark, path, DOCUMENT_DDL, fmt)


def read_sentences(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, SENTENCE_DDL, fmt)


def read_rewrites(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Pairs of original and corrected text, by corrector."""
    return read_table(spark, path, REWRITE_DDL, fmt)


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``order``: a top-n, not a full sort."""
    return df.orderBy(order).limit(n)
