"""From documents to packed training sequences: five stages, each a table for the next.

All stages take null and empty texts, texts of any length (always whole), ties, repeated rows and
empty tables, and keep all columns, whatever their names; each says what becomes of them.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redpen.llm import decontamination, packing, pii, simhash, toxicity
from redpen.llm.common import keep_table, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. The lexicon is learned from the labels outside the held-out rows.

    Null and empty texts have no match and stay; repeated rows go or stay together; a score at
    the threshold goes; an empty table stays empty. Without labels nothing is learned and all stay.
    """
    return toxicity.drop_toxic(docs, toxicity.learn_lexicon(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of every class linked by shingles of five words at a similarity of 0.8.

    Texts without words, null ones too, are one class; of repeated rows one stays; the smallest
    doc_id stays, a null one only if its class has no other; an empty table stays empty.
    """
    return simhash.drop_near_duplicates(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts share nothing and stay; repeated rows go or stay together; an empty
    table stays empty, and an empty benchmark takes nothing out.
    """
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are generalised; n_chars follows the text.

    One row per row: null texts stay null, empty ones empty, repeated rows change alike; an
    empty table stays empty.
    """
    clean = pii.sanitise(docs)
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType))
    return clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, one row per piece; null texts are empty, repeated rows are packed one by one."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", sanitise),
    ("best_fit_packing", pack),
]
# No stage but decontamination could be told in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Every stage but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {}
