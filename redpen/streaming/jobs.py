"""Streaming forms: continuous checking, reuse, merging of late correctors, sliding failure rates."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from redpen.operators import fanout, merge, project
from redpen.operators.correctors import Corrector
from redpen.plans.check import check_sentences


def check_stream(
    documents: DataFrame, correctors: list[Corrector], language: str | None = None, max_length: int | None = None
) -> DataFrame:
    """Document stream to a stream of sentences with merged matches.

    Merging works inside the row, so the job keeps no state and a restart
    repeats nothing but the open batch.
    """
    return check_sentences(project.sentences(documents), correctors, False, language, max_length)


def first_seen(stream: DataFrame, ts: str, keys: list[str], delay: str) -> DataFrame:
    """Drop repeats of a text within the watermark; state is bounded by the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def known_results(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The table of known results: one folder per batch. ``before`` leaves out later versions."""
    numbered = StructType([*schema.fields, StructField("batch", LongType())])
    table = spark.read.schema(numbered).option("basePath", path).parquet(f"{path}/batch=*")
    return (table if before is None else table.where(F.col("batch") < before)).drop("batch")


def reuse_in_batches(
    stream: DataFrame, compute: Callable[[DataFrame], DataFrame], computed: StructType, path: str, known: str,
    checkpoint: str, text: str = "text",
) -> None:
    """Every row of a stream with its result, each text computed once, however often and late it comes again.

    ``compute`` takes a table of distinct texts and adds columns; ``computed`` is its schema. A
    batch asks the table of known results, computes only what is not there, and adds that as its
    own folder. A batch that is run again, after a failure, reads only the folders of earlier
    batches and writes its own ones anew, so neither table ever holds a row twice. Runs over what
    is there now; results are at ``path``.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], computed).write.mode("overwrite").parquet(f"{known}/batch=-1")

    def one(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        earlier = known_results(session, known, computed, number)
        asked = batch.select(text).where(F.col(text).isNotNull()).distinct()
        fresh = compute(asked.join(earlier.select(text), text, "left_anti")).select(*computed.fieldNames())
        fresh.write.mode("overwrite").parquet(f"{known}/batch={number}")
        own = session.read.schema(computed).parquet(f"{known}/batch={number}")
        both = earlier.withColumn("reused", F.lit(True)).unionByName(own.withColumn("reused", F.lit(False)))
        results = fanout.spread_join(batch, both, [text], "left")
        results.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def merge_match_stream(matches: DataFrame, keys: list[str], ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Merged matches of a stream in which the correctors' rows arrive apart and in any order.

    Rows have ``corrector_idx, match_idx, offset, length, replacement`` and ``ts``, the time the
    sentence was asked for, the same for all its rows. A sentence is given out once, when the
    watermark passes that time by ``delay``: first of each span and replacement, by offset.
    State holds open sentences only; a stream starts at 1970, and earlier times are late. Rows that come later are cut; ``n_rows`` says how many rows
    a sentence was merged from, so the cut ones are what arrived less their sum.
    """
    item = F.struct("corrector_idx", "match_idx", "offset", "length", "replacement")
    gathered = matches.withWatermark(ts, delay).groupBy(*keys, ts).agg(F.collect_list(item).alias("_items"))
    merged = merge.merge_arrays(F.array_sort("_items"))
    return gathered.select(*keys, ts, merged.alias("matches"), F.size("_items").alias("n_rows"))


def sliding_failure_rates(
    calls: DataFrame, window: str, slide: str, delay: str, min_calls: int = 10, threshold: float = 50.0
) -> DataFrame:
    """Failure rate per rule and sliding window; rows later than ``delay`` are cut off."""
    agg = (
        calls.withWatermark("ts", delay)
        .groupBy(F.window("ts", window, slide), "rule_id")
        .agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures"))
    )
    rate = F.col("failures") * 100.0 / F.col("calls")
    return agg.where(F.col("calls") >= min_calls).select(
        "rule_id",
        F.unix_seconds("window.start").alias("window_start"),
        F.unix_seconds("window.end").alias("window_end"),
        "calls",
        "failures",
        rate.alias("failure_rate"),
        (rate >= threshold).alias("open"),
    )


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now, into parquet files."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
