"""Fan-out to correctors, one computation per distinct text, result reuse."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.operators.skew import cut_off, key_counts, spread_join
from redpen.sources.sinks import shared_folder


def fan_out(sentences: DataFrame, rule_ids: list[str]) -> DataFrame:
    """Every text to every corrector. The list is part of the plan: no join, no shuffle."""
    each = F.array(*[F.lit(r) for r in rule_ids])
    return sentences.select("*", F.posexplode(each).alias("corrector_idx", "rule_id"))


KEY = "_text_key"


def text_key(text: str) -> Column:
    """128 bits that stand for a text, so that no text of any length is a shuffle, join or broadcast key."""
    return F.unhex(F.md5(text))


def _asked(rows: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their key, and the distinct texts with key and count."""
    keyed = rows.withColumn(KEY, text_key(text))
    return keyed, key_counts(keyed, [KEY, text])


def _joined(keyed: DataFrame, known: DataFrame, counts: DataFrame, text: str) -> DataFrame:
    """Rows with what is known of their text; very frequent texts are spread over several tasks."""
    right = known.withColumn(KEY, text_key(text)).drop(text)
    out = spread_join(keyed, right, [KEY], "left", counts.select(KEY, "_rows")).drop(KEY)
    return out.select(text, *[c for c in out.columns if c != text])


def once_per_text(
    sentences: DataFrame, compute: Callable[[DataFrame], DataFrame], text: str = "text"
) -> DataFrame:
    """Run ``compute`` on the distinct texts only and join the result back.

    ``compute`` takes a table with the text column and adds columns. Copies of a
    text are counted before the shuffle; results are joined back by the key of the text, and
    very frequent texts are spread over several tasks on the way back.
    """
    keyed, counts = _asked(sentences, text)
    return _joined(keyed, compute(counts.select(text)), counts, text)


def successful_only(results: DataFrame, ok: str = "ok") -> DataFrame:
    """Single-text mode: failed correctors vanish."""
    return results.where(ok)


def pad_failures(
    fanned: DataFrame, results: DataFrame, keys: list[str], column: str = "matches"
) -> DataFrame:
    """Batch mode: a failed corrector yields an empty list for each of its texts."""
    ids = [*keys, "corrector_idx"]
    empty = F.array().cast(results.schema[column].dataType)
    done = results.select(*ids, column)
    return fanned.join(done, ids, "left").withColumn(column, F.coalesce(column, empty))


def reuse(
    requests: DataFrame,
    cache: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Read hits from ``cache``, compute misses, and return (results, cache to keep).

    Misses are computed here, once: they are written to the shared folder, and both results
    read them from there.

    ``cache`` has one row per text. Hits and misses are decided on distinct texts,
    so copies of a text never meet in one task before the final, spread join.
    """
    keyed, counts = _asked(requests, text)
    asked, stored = counts.select(KEY, text), cache.withColumn(KEY, text_key(text))
    hits = stored.join(asked.select(KEY), KEY, "left_semi").drop(KEY).withColumn("hit", F.lit(True))
    misses = compute(asked.join(stored.select(KEY), KEY, "left_anti").select(text))
    path = shared_folder(requests.sparkSession, "misses")
    misses.write.parquet(path)
    computed = requests.sparkSession.read.schema(misses.schema).parquet(path)
    known = hits.unionByName(computed.withColumn("hit", F.lit(False)))
    refilled = cache.unionByName(computed)
    return _joined(keyed, known, counts, text), refilled


def keep_latest(cache: DataFrame, capacity: int, used: str = "used", text: str = "text") -> DataFrame:
    """The ``capacity`` entries used last; entries used at the same time in the order of their text's digest.

    The cut is found by counting, so there is no sort over the table and no window over it: a
    few passes count entries in ever finer ranges of ``used``, then, only where entries at the
    cut were used at the same time, of the digest.
    """
    digest = F.md5(text)
    parts = [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]
    ordered = cache.withColumns({"_o0": -F.col(used), "_o1": parts[0], "_o2": parts[1]})
    return cut_off(ordered, ["_o0", "_o1", "_o2"], capacity).drop("_o0", "_o1", "_o2")


def reuse_bounded(
    requests: DataFrame,
    cache: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    capacity: int,
    asked: str = "asked",
    used: str = "used",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Reuse with a table that does not grow for ever: (results, cache to keep).

    As :func:`reuse`; ``cache`` also has ``used``, a whole number that says when an entry was
    used last, and ``requests`` has ``asked`` on the same scale. An entry that is asked for
    moves up to its last request; then the ``capacity`` entries used last stay. The new cache is
    written to the shared folder once.
    """
    results, refilled = reuse(requests, cache.drop(used), compute, text)
    latest = requests.groupBy(text).agg(F.max(asked).alias("_asked"))
    known = cache.select(F.col(text).alias("_known"), F.col(used).alias("_used"))
    lowest = F.lit(-(1 << 62))
    dated = refilled.join(latest, text, "left").join(known, F.col(text) == F.col("_known"), "left").withColumn(
        used, F.greatest(F.coalesce("_asked", lowest), F.coalesce("_used", lowest))
    ).drop("_asked", "_known", "_used")
    path = shared_folder(requests.sparkSession, "reuse")
    dated.write.parquet(path)
    kept = keep_latest(requests.sparkSession.read.schema(dated.schema).parquet(path), capacity, used, text)
    return results, kept


def align(sentences: DataFrame, results: DataFrame, keys: list[str], column: str = "matches") -> DataFrame:
    """One list per requested sentence, empty where nothing was found."""
    empty = F.array().cast(results.schema[column].dataType)
    return sentences.join(results, keys, "left").withColumn(column, F.coalesce(column, empty))
