"""Merging the matches of several correctors."""

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redpen.functions.text import let

LANGUAGE, LANGUAGE_CODE = "English", "en-US"


def merge_arrays(matches: Column) -> Column:
    """First of each (offset, length, replacement), sorted by offset; ties keep their order.

    ``matches`` is one sentence's array in corrector order, then match order. It
    is no longer than the sentence has tokens times correctors. Equal keys are
    neighbours once sorted, so the work is that of two sorts. ``sort_array`` builds its order once
    a task, ``array_sort`` and a struct within a struct one for every comparison.
    """
    key = ("offset", "length", "replacement")
    keyed = F.transform(matches, lambda m, i: F.struct(*[m[k].alias(k) for k in key], i.alias("i"), m.alias("m")))

    def same(x: Column, y: Column) -> Column:
        return functools.reduce(operator.and_, [x[k].eqNullSafe(y[k]) for k in key])

    first = let(
        F.sort_array(keyed),
        lambda s: F.filter(s, lambda x, k: (k == 0) | ~same(x, F.get(s, k - 1))),
    )
    ranked = F.transform(first, lambda x: F.struct(x.m.offset.alias("o"), x.i.alias("i"), x.m.alias("m")))
    return F.transform(F.sort_array(ranked), lambda r: r.m)


def distinct_matches(matches: DataFrame, keys: list[str]) -> DataFrame:
    """First match per sentence, span and replacements, by corrector, then match order.

    Works on a table of matches with ``replacements ARRAY<STRING>`` or a scalar
    ``replacement``. Duplicates collapse before the shuffle, so a span repeated by
    very many correctors costs one row per task.
    """
    what = "replacements" if "replacements" in matches.columns else "replacement"
    group = [*keys, "offset", "length", what]
    rest = [c for c in matches.columns if c not in group]
    ordered = ["corrector_idx", "match_idx"] + [
        c for c in rest if c not in ("corrector_idx", "match_idx")
    ]
    first = matches.groupBy(*group).agg(F.min(F.struct(*ordered)).alias("_f"))
    return first.select(*[F.col(f"_f.{c}") if c in rest else F.col(c) for c in matches.columns])


def replacement_list(suggested: Column, suggestions: Column) -> Column:
    """Replacements that identify a match: suggested ones, else suggestions, else none."""
    return (
        F.when(F.size(suggested) > 0, F.transform(suggested, lambda r: r.replacement))
        .when(F.size(suggestions) > 0, suggestions)
        .otherwise(F.array().cast("array<string>"))
    )


def order_matches(matches: DataFrame, keys: list[str], out: str = "rank") -> DataFrame:
    """Number the matches of each sentence by offset; ties by corrector, then match order."""
    w = Window.partitionBy(*keys).orderBy("offset", "corrector_idx", "match_idx")
    return matches.withColumn(out, F.row_number().over(w))


def by_confidence(matches: DataFrame, keys: list[str], out: str = "rank") -> DataFrame:
    """Number the matches of each sentence by falling score, then offset."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "offset", "corrector_idx", "match_idx")
    return matches.withColumn(out, F.row_number().over(w))


def nested_results(matches: DataFrame, keys: list[str]) -> DataFrame:
    """One row per sentence: the ordered list of matches and the language constants."""
    rest = [c for c in matches.columns if c not in keys and c not in ("offset", "corrector_idx", "match_idx")]
    item = F.struct("offset", "corrector_idx", "match_idx", *rest)
    return (
        matches.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(item)).alias("matches"))
        .withColumns({"language": F.lit(LANGUAGE), "language_code": F.lit(LANGUAGE_CODE)})
    )


def text_major(results: DataFrame, keys: list[str]) -> DataFrame:
    """Regroup corrector-major results: per text, the list over correctors in their order."""
    rest = [c for c in results.columns if c not in keys and c != "corrector_idx"]
    return results.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("corrector_idx", *rest))).alias("results")
    )


def flatten_results(results: DataFrame, keys: list[str], column: str = "matches") -> DataFrame:
    """Flat list of matches in sentence order; offsets stay relative to the sentence."""
    return results.select(*keys, F.posexplode_outer(column).alias("rank", "_m")).where(
        F.col("rank").isNotNull()
    ).select(*keys, "rank", "_m.*")


def isolate_failures(results: DataFrame, error: str = "error", column: str = "matches") -> DataFrame:
    """A text that failed keeps its row with an empty result; the others stay as they are."""
    empty = F.array().cast(results.schema[column].dataType)
    return results.withColumn(
        column, F.when(F.col(error).isNotNull(), empty).otherwise(F.coalesce(column, empty))
    )
