"""Rules that drop an edit. Each works on plain columns; any hit drops the edit."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.functions import text as X


def capital_bullet(n: Column, o_start: Column, o_str: Column, c_str: Column) -> Column:
    """Case-only change at the start of a short text (a bullet point)."""
    return (n < 7) & (o_start == 0) & (F.lower(o_str) == F.lower(c_str))


def trailing_colon(n: Column, o_end: Column, o_str: Column, c_str: Column) -> Column:
    """A colon put at the end of a very short text."""
    return (n < 5) & F.endswith(c_str, F.lit(":")) & (o_end == n) & ~F.endswith(o_str, F.lit(":"))


def trailing_period(n: Column, o_end: Column, c_str: Column) -> Column:
    """A period in an edit that reaches the end of a short text."""
    return (n < 10) & F.contains(c_str, F.lit(".")) & (o_end == n)


def colon_for_spaces(
    n: Column, o_end: Column, o_str: Column, c_str: Column, original: Column
) -> Column:
    """Trailing spaces turned into a colon while the user is still typing."""
    return (
        (o_end == n)
        & F.endswith(c_str, F.lit(":"))
        & (X.strip(o_str) == "")
        & (X.rstrip(original) != original)
    )


def emoji_only(o_str: Column, c_str: Column, strict: bool = False) -> Column:
    """Only emoji or whitespace differ."""
    return X.normalise_emoji(o_str, strict) == X.normalise_emoji(c_str, strict)


def reason(e: Column, n: Column, original: Column, strict_emoji: bool = False) -> Column:
    """First rule that drops edit struct ``e``, null if it is kept."""
    return (
        F.when(capital_bullet(n, e.o_start, e.o_str, e.c_str), "capital_bullet")
        .when(trailing_colon(n, e.o_end, e.o_str, e.c_str), "trailing_colon")
        .when(trailing_period(n, e.o_end, e.c_str), "trailing_period")
        .when(colon_for_spaces(n, e.o_end, e.o_str, e.c_str, original), "colon_for_spaces")
        .when(emoji_only(e.o_str, e.c_str, strict_emoji), "emoji_only")
    )


def with_reason(edits: DataFrame, strict_emoji: bool = False) -> DataFrame:
    """Add ``suppress_reason`` to a table of typed edits."""
    e = F.struct(*[F.col(c).alias(c) for c in ("o_start", "o_end", "o_str", "c_str")])
    return edits.withColumn("_e", e).withColumn(
        "suppress_reason",
        reason(F.col("_e"), F.col("n_tokens"), F.col("original"), strict_emoji),
    ).drop("_e")
