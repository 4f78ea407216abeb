"""Quality rules and a hashed n-gram likelihood ratio. DataFrame functions only."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.functions.text import let
from redpen.llm.common import SPACE, keep_table, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
# Features of the likelihood ratio: words and runs of punctuation, alone and in pairs.
FEATURE = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]+"


def repeated_words(ws: Column) -> Column:
    """Words in windows of five that occur twice or more in the text, the first included.

    Hashes tell at once that nothing repeats; only texts in which two hashes agree compare
    the windows themselves. Work is that of one sort of the windows.
    """
    last = F.size(ws) - F.lit(WINDOW)

    def covered(at: Column) -> Column:
        steps = F.zip_with(
            F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at)), lambda a, b: F.least(b - a, F.lit(WINDOW))
        )
        return F.aggregate(steps, F.lit(WINDOW), lambda acc, n: acc + n)

    def exact(w: Column) -> Column:
        windows = F.array_sort(
            F.transform(
                F.sequence(F.lit(0), last),
                lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("w"), i.alias("i")),
            )
        )

        def repeats(s: Column) -> Column:
            n = F.size(s)
            same = F.zip_with(
                F.slice(s, 1, n - 1), F.slice(s, 2, n), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"]))
            )
            return F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))

        return let(let(windows, repeats), lambda at: F.when(F.size(at) > 0, covered(at)).otherwise(0))

    def mixed(a: Column, b: Column, apart: int) -> Column:
        """Each hash of ``a`` with that of ``b`` which is ``apart`` places further on."""
        n = F.size(b) - apart
        return F.zip_with(
            F.slice(a, 1, n), F.slice(b, apart + 1, n), lambda x, y: F.shiftleft(x, apart).bitwiseXOR(y)
        )

    def windows_of(single: Column) -> Column:
        """One hash per window of five: each word is hashed once, pairs make fours, fours and a word make fives."""
        fours = let(mixed(single, single, 1), lambda two: mixed(two, two, 2))
        return mixed(fours, single, WINDOW - 1)

    def decided(w: Column) -> Column:
        hashes = let(F.transform(w, lambda t: F.xxhash64(t)), windows_of)
        return let(
            hashes, lambda h: F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0)).otherwise(exact(w))
        )

    return F.when(last > 0, let(ws, decided)).otherwise(0).cast("long")


def base_measures(text: Column) -> dict[str, Column]:
    """The base columns of a text by name. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    ws = words(text)
    return {
        "n_words": F.size(ws).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(ws),
    }


def feature_hashes(text: Column) -> Column:
    """Hashes of all words and punctuation runs, and of all pairs of neighbours."""

    def hashed(tokens: Column) -> Column:
        single = F.transform(tokens, lambda t: F.xxhash64(t))
        return let(
            single,
            lambda h: F.concat(
                h, F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.size(h)),
                              lambda a, b: F.shiftleft(a, 1).bitwiseXOR(b))
            ),
        )

    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FEATURE), F.lit(0))
    return hashed(tokens)


def bucket_of(hashed: Column, buckets: int) -> Column:
    return F.pmod(hashed, F.lit(buckets)).cast("int")


def fit_weights(documents: DataFrame, trusted: DataFrame, buckets: int, smoothing: float = 1.0) -> list[float]:
    """Log ratio of the target and raw multinomials per bucket.

    The raw counts are those of every document. The target is every trusted document; ``trusted``
    has distinct ids, as many as there are. ``buckets`` numbers reach the driver, whatever the input.
    """
    # Texts meet the ids by the same kind of join at every size: each text is shuffled once.
    marked = documents.select("doc_id", "text").join(
        trusted.select("doc_id", F.lit(1).alias("_trusted")).hint("merge"), "doc_id", "left"
    )
    counts = (
        marked.select("_trusted", F.explode(feature_hashes(F.col("text"))).alias("hashed"))
        .groupBy(bucket_of(F.col("hashed"), buckets).alias("bucket")).agg(F.count("*").alias("raw"), F.count("_trusted").alias("target"))
        .collect()  # one row per bucket
    )
    raw = [smoothing] * buckets
    target = [smoothing] * buckets
    for row in counts:
        raw[row.bucket] += row.raw
        target[row.bucket] += row.target
    if not any(row.target for row in counts):
        return [0.0] * buckets  # nothing is trusted, so nothing is told apart
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(r) + shift for t, r in zip(target, raw, strict=True)]


def judge_quality(
    documents: DataFrame, labels: DataFrame, buckets: int = 1 << 14, deviations: float = 6.0
) -> DataFrame:
    """Base measures, likelihood ratio and verdict of every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    score, kept. The score is the mean log ratio between the trusted target and the raw
    corpus over a text's hashed words and pairs. A document is kept if it passes the base
    rules and scores no lower than ``deviations`` standard deviations below the mean of the
    trusted documents. Nothing is drawn: the target and the threshold cover every document of
    label quality 1, the raw counts all documents. Scores are kept as a table, so that only ids
    and scores meet the labels for the threshold.

    Null and empty texts have no words and fail the base rules; their score is 0. Without
    trusted documents all ratios are 0 and the base rules decide. Repeated rows are judged
    alike. A null doc_id is kept. Columns other than doc_id and text are not read.
    """
    trusted = labels.where("quality = 1").select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    weights = fit_weights(documents, trusted, buckets)
    spark = documents.sparkSession
    table = spark.createDataFrame([(weights,)], "w array<double>").scalar()
    mean_weight = let(
        feature_hashes(F.col("text")),
        lambda h: F.aggregate(h, F.lit(0.0), lambda acc, x: acc + F.get("_weights", bucket_of(x, buckets)))
        / F.greatest(F.size(h), F.lit(1)),
    )
    scored = F.round(mean_weight, 9)
    rows = documents.select("doc_id", "text", table.alias("_weights"))
    measures = base_measures(F.col("text"))
    out = rows.select("doc_id", *[c.alias(n) for n, c in measures.items()], scored.alias("score"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = keep_table(out.withColumn("base_failed", failed), "quality")
    known = judged.select("doc_id", "score").join(trusted, "doc_id", "left_semi")
    spread = known.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation")).first()
    least = float("-inf") if spread.mean is None else round(spread.mean - deviations * spread.deviation, 9)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)))
