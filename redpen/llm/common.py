"""Small helpers that the training-data operators share."""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redpen.sources.sinks import shared_folder

# Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other letter stays."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def keep_table(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, and gives later passes one fixed copy that survives lost executors.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_keys(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two key columns, _k1 and _k2, for joining results back to rows: equal rows share them, a null id has its own."""
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("_k1"),
        F.xxhash64(F.col(doc_id).isNull(), F.coalesce(F.col(text), F.lit(""))).alias("_k2"),
    ]


def packed(documents: DataFrame) -> DataFrame:
    """The row as one column _row beside its keys, so that no other column can clash with a name used inside."""
    return documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("_row"), *row_keys())


def smallest_by_hash(ids: DataFrame, column: str, bound: int) -> DataFrame:
    """At most ``bound`` ids, the same ones whatever the partitioning. For bounded fitting samples."""
    return (
        ids.select(column).where(F.col(column).isNotNull()).distinct()
        .orderBy(F.xxhash64(column), column).limit(bound)
    )


def slices(batches: Iterator, rows: int) -> Iterator:
    """Arrow batches of at most ``rows`` rows, so that few rows at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
