"""Putting matches into their text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.functions.text import let
from redpen.operators.merge import nested_results

# Kept matches are folded in blocks, so that a row of n matches copies n * n / BLOCK elements at most.
BLOCK = 64
SPAN = "array<struct<offset:int,length:int,replacement:string>>"


def kept_matches(text: Column, matches: Column) -> Column:
    """The matches that can be put into the text together: offset, length, replacement, left to right.

    Overlaps go to the first by offset, then the longest, then the one listed first; an
    insertion at the end of a kept match stays. Matches with a null field or outside the text
    are left out.
    """
    valid = F.filter(
        matches,
        lambda m: (m.offset >= 0) & (m.length >= 0) & (m.offset + m.length <= F.length(text)) & m.replacement.isNotNull(),
    )

    def span(m: Column) -> Column:
        return F.struct(m.offset.alias("offset"), m.length.alias("length"), m.replacement.alias("replacement"))

    def keyed(found: Column) -> Column:
        return F.transform(
            found,
            lambda m, i: F.struct(
                m.offset.cast("int").alias("offset"), (-m.length).cast("int").alias("minus"), i.alias("i"),
                m.length.cast("int").alias("length"), m.replacement.alias("replacement"),
            ),
        )

    none = F.array().cast(SPAN)

    def take(acc: Column, m: Column) -> Column:
        free = m.offset >= acc.end
        return F.struct(
            F.when(free, m.offset + m.length).otherwise(acc.end).alias("end"),
            F.when(free, F.concat(acc.kept, F.array(span(m)))).otherwise(acc.kept).cast(SPAN).alias("kept"),
        )

    def state(end: Column, kept: Column) -> Column:
        return F.struct(end.cast("int").alias("end"), kept.cast(SPAN).alias("kept"))

    def fold(block: Column, end: Column) -> Column:
        return F.aggregate(block, state(end, none), take)

    def blocks(ordered: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.ceil(F.size(ordered) / F.lit(BLOCK)).cast("int") - 1)

        def add(acc: Column, b: Column) -> Column:
            return let(
                fold(F.slice(ordered, b * BLOCK + 1, F.lit(BLOCK)), acc.end),
                lambda done: state(done.end, F.concat(acc.kept, done.kept)),
            )

        return F.aggregate(numbers, state(F.lit(0), none), add, lambda acc: acc.kept)

    # A match on its own overlaps nothing, so nothing is sorted or folded.
    return let(
        valid,
        lambda v: F.when(F.size(v) < 2, F.transform(v, span).cast(SPAN)).otherwise(let(F.array_sort(keyed(v)), blocks)),
    )


def spliced(text: Column, kept: Column) -> Column:
    """The text with non-overlapping matches, given left to right, in place."""

    def piece(m: Column, i: Column) -> Column:
        before = F.get(kept, i - 1)
        start = F.coalesce(before.offset + before.length, F.lit(0))
        return F.concat(F.substring(text, start + 1, m.offset - start), m.replacement)

    last = F.get(kept, F.size(kept) - 1)
    tail = F.substring(text, F.coalesce(last.offset + last.length, F.lit(0)) + 1, F.length(text))
    return F.concat(F.array_join(F.transform(kept, piece), ""), tail)


def apply_matches(df: DataFrame, text: str = "text", matches: str = "matches", out: str = "applied") -> DataFrame:
    """Add the corrected text and ``n_applied``, all in the row.

    A null text stays null; a null or empty list leaves the text as it is. ``n_applied`` counts
    the matches that were put in; the others overlap these or lie outside the text.
    """
    listed = F.coalesce(F.col(matches), F.array().cast(df.schema[matches].dataType))
    held = df.withColumn("_kept", kept_matches(F.col(text), listed))
    return held.withColumns(
        {out: spliced(F.col(text), F.col("_kept")), "n_applied": F.coalesce(F.size("_kept"), F.lit(0))}
    ).drop("_kept")


def apply_match_rows(
    sentences: DataFrame, matches: DataFrame, keys: list[str], text: str = "text", out: str = "applied"
) -> DataFrame:
    """The same for a table of matches, one row each. Sentences without a match keep their text."""
    nested = nested_results(matches, keys).select(*keys, "matches")
    return apply_matches(sentences.join(nested, keys, "left"), text, "matches", out).drop("matches")
