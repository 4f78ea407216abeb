"""Column expressions over arrays of class scores."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from redpen.functions import patterns as P


def softmax(logits: Column) -> Column:
    x = logits.cast("array<double>")
    top = F.array_max(x)
    weights = F.transform(x, lambda v: F.exp(v - top))
    return _normalised(weights)


def _normalised(weights: Column) -> Column:
    total = F.aggregate(weights, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(weights, lambda v: v / total)


def calibrated(logits: Column, calibrators: list[tuple[list[float], float]]) -> Column:
    """One logistic model per class over all logits, then scaled to sum to one.

    ``calibrators`` holds (coefficients, intercept) per class id. It is model
    configuration, one entry per class, so it sits in the plan as literals.
    """
    x = logits.cast("array<double>")

    def positive(coef: list[float], intercept: float) -> Column:
        weights = F.array(*[F.lit(float(c)) for c in coef])
        dot = F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(dot + F.lit(float(intercept)))))

    return _normalised(F.array(*[positive(c, b) for c, b in calibrators]))


def label_name(class_id: Column, labels: dict[int, str] | None = None) -> Column:
    """Label of a class id, ``LABEL_i`` where there is none."""
    fallback = F.concat(F.lit("LABEL_"), class_id.cast("string"))
    if not labels:
        return fallback
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(names, class_id), fallback)


def argmax(scores: Column) -> Column:
    """Class id of the largest score, the lowest id on a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def ranked(scores: Column) -> Column:
    """Structs (class_id, score) by falling score, lowest class id first on a tie."""
    keyed = F.transform(
        scores, lambda s, i: F.struct((-s).alias("k"), i.alias("class_id"), s.alias("score"))
    )
    return F.transform(
        F.array_sort(keyed), lambda r: F.struct(r.class_id.alias("class_id"), r.score.alias("score"))
    )


def parsed_output(payload: Column) -> Column:
    """Classifier output ``{"label", "score"}``; text that is no JSON is ``unknown``, 0.0."""
    schema = "label STRING, score DOUBLE, _bad STRING"
    row = F.from_json(payload, schema, {"columnNameOfCorruptRecord": "_bad"})
    broken = row["_bad"].isNotNull() | payload.isNull() | F.try_parse_json(payload).isNull()
    return F.struct(
        F.when(broken, "unknown").otherwise(row["label"]).alias("label"),
        F.when(broken, F.lit(0.0)).otherwise(row["score"]).alias("score"),
    )


def in_range(label: Column, score: Column) -> Column:
    return F.coalesce(label.isNotNull() & score.between(0.0, 1.0), F.lit(False))


def marked(original: Column, replacement: Column) -> Column:
    return F.concat(
        F.lit(P.REPLACE_OPEN), original, F.lit(P.SEP_TOKEN),
        F.coalesce(replacement, original), F.lit(P.REPLACE_CLOSE),
    )
