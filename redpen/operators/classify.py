"""Classifier inputs and outputs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.functions import patterns as P
from redpen.functions import scores as S
from redpen.functions.text import let, running_sums, span_text
from redpen.operators.correctors import BatchFunction, rewrite_batches


def without_overlaps(matches: Column) -> Column:
    """Drop matches that overlap an earlier one: first by offset, then the longest."""
    keyed = F.transform(
        matches,
        lambda m, i: F.struct(m.offset.alias("o"), (-m.length).alias("l"), i.alias("i"), m.alias("m")),
    )

    def kept(ordered: Column) -> Column:
        """Positions kept; the end of the last kept match decides on the next."""
        found = F.aggregate(
            F.sequence(F.lit(1), F.size(ordered)),
            F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at")),
            lambda acc, k: F.when(
                F.get(ordered, k - 1).o >= acc.end,
                F.struct(
                    (F.get(ordered, k - 1).m.offset + F.get(ordered, k - 1).m.length).alias("end"),
                    F.concat(acc["at"], F.array(k - 1)).alias("at"),
                ),
            ).otherwise(acc),
        )
        return let(found["at"], lambda at: F.transform(at, lambda k: F.get(ordered, k).m))

    # Sorted once: the array is bound before the fold reads it.
    return F.when(F.size(matches) == 0, matches).otherwise(let(F.array_sort(keyed), kept))


def _segments(sentence: Column, matches: Column) -> Column:
    """Per match the text since the match before it (``gap``) and the marked correction."""

    def segment(m: Column, i: Column) -> Column:
        prev = F.get(matches, i - 1)
        pointer = F.when(i == 0, 0).otherwise(prev.offset + prev.length)
        gap = F.when(m.offset > pointer, span_text(sentence, pointer, m.offset - pointer)).otherwise("")
        mark = S.marked(span_text(sentence, m.offset, m.length), m.replacement)
        return F.struct(gap.alias("gap"), mark.alias("mark"))

    return F.transform(matches, segment)


def _tail(sentence: Column, matches: Column) -> Column:
    last = F.get(matches, F.size(matches) - 1)
    pointer = F.coalesce(last.offset + last.length, F.lit(0))
    return F.when(
        pointer < F.length(sentence), span_text(sentence, pointer, F.length(sentence))
    ).otherwise("")


def feature(sentence: Column, matches: Column, selected: Column) -> Column:
    """Sentence with all corrections marked and the selected one preceded by ``<CLS>``.

    Matches are walked in the given order.
    """
    parts = F.transform(
        _segments(sentence, matches),
        lambda s, i: F.concat(s.gap, F.when(i == selected, P.CLS_TOKEN).otherwise(""), s.mark),
    )
    return F.concat(F.array_join(parts, ""), _tail(sentence, matches))


def features_per_match(
    df: DataFrame, sentence: str = "text", matches: str = "matches", overlaps: bool = True
) -> DataFrame:
    """One feature string per candidate match of a sentence.

    The marked sentence is built once; each candidate only inserts its ``<CLS>``
    at a known place, so no match is paired with another.
    """
    keep = [c for c in df.columns if c not in (sentence, matches)]
    if not overlaps:
        df = df.withColumn(matches, without_overlaps(F.col(matches)))
    df = df.withColumn("_seg", _segments(F.col(sentence), F.col(matches)))
    df = df.withColumns(
        {
            "_full": F.concat(
                F.array_join(F.transform("_seg", lambda s: F.concat(s.gap, s.mark)), ""),
                _tail(F.col(sentence), F.col(matches)),
            ),
            "_at": F.zip_with(
                running_sums(F.transform("_seg", lambda s: F.length(s.gap) + F.length(s.mark))),
                F.col("_seg"),
                lambda e, s: e - F.length(s.mark),
            ),
        }
    )
    full, at = F.col("_full"), F.col("_p")
    return (
        df.select(*keep, "_full", F.posexplode_outer("_at").alias("selected", "_p"))
        .where(F.col("selected").isNotNull())
        .select(
            *keep,
            "selected",
            F.concat(
                F.substring(full, F.lit(1), at), F.lit(P.CLS_TOKEN), F.substring(full, at + 1, F.length(full))
            ).alias("feature"),
        )
    )


def classify_matches(
    df: DataFrame, function: BatchFunction, sentence: str = "text", matches: str = "matches",
    batch_size: int = 8, overlaps: bool = True,
) -> DataFrame:
    """Label and score of every match by a user classifier over its feature.

    ``function`` builds, once per task, a function from a batch of features to as many outputs
    ``{"label", "score"}`` as text. Outputs that are no JSON, and features that the function
    fails on, are ``unknown`` with score 0; ``error`` names the failure.
    """
    rows = features_per_match(df, sentence, matches, overlaps)
    told = rewrite_batches(rows, function, "feature", "feature", "_payload", batch_size)
    parsed = S.parsed_output(F.col("_payload"))
    return told.withColumn("_parsed", parsed).withColumns(
        {"label": F.col("_parsed.label"), "score": F.col("_parsed.score")}
    ).drop("_payload", "_parsed")


def with_probabilities(
    df: DataFrame,
    calibrators: list[tuple[list[float], float]] | None = None,
    logits: str = "logits",
    uncalibrated: bool = False,
) -> DataFrame:
    """Add ``probs`` (calibrated, or softmax without calibrators) and, on request, ``raw_probs``."""
    probs = S.calibrated(F.col(logits), calibrators) if calibrators else S.softmax(F.col(logits))
    df = df.withColumn("probs", probs)
    return df.withColumn("raw_probs", S.softmax(F.col(logits))) if uncalibrated else df


def top_labels(df: DataFrame, k: int = 1, labels: dict[int, str] | None = None) -> DataFrame:
    """The ``k`` best classes of each row: ``rank``, ``class_id``, ``label``, ``score``."""
    keep = [c for c in df.columns if c not in ("probs", "logits", "raw_probs")]
    best = F.slice(S.ranked(F.col("probs")), 1, k)
    return (
        df.select(*keep, F.posexplode_outer(best).alias("_r", "_b"))
        .where(F.col("_r").isNotNull())
        .select(
            *keep,
            (F.col("_r") + 1).alias("rank"),
            F.col("_b.class_id").alias("class_id"),
            S.label_name(F.col("_b.class_id"), labels).alias("label"),
            F.col("_b.score").alias("score"),
        )
    )


def best_label(df: DataFrame, labels: dict[int, str] | None = None) -> DataFrame:
    """Add ``class_id``, ``label`` and ``score`` of the largest probability."""
    df = df.withColumn("class_id", S.argmax(F.col("probs")))
    return df.withColumns(
        {
            "label": S.label_name(F.col("class_id"), labels),
            "score": F.get("probs", F.col("class_id")),
        }
    )


def probability_vector(outputs: Column, label_ids: dict[str, int]) -> Column:
    """Scores of (label, score) structs in the order of their label ids."""
    ids = F.create_map(*[F.lit(x) for pair in label_ids.items() for x in pair])
    keyed = F.transform(
        outputs, lambda o: F.struct(F.try_element_at(ids, o.label).alias("id"), o.score.alias("score"))
    )
    return F.transform(F.array_sort(keyed), lambda o: o.score)


def range_violations(df: DataFrame) -> DataFrame:
    """How many classifier outputs are in range and how many are not."""
    ok = S.in_range(F.col("label"), F.col("score"))
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(ok).alias("n_valid"),
        F.count_if(~ok).alias("n_invalid"),
    )
