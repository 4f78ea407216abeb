"""Joins and running sums that survive one key holding a large share of all rows."""

import functools
import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/SHARES of all rows. At most SHARES keys
# can, whatever the data: that bounds the broadcast and the copies below.
SHARES = 512


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("_rows"))


def hot_keys(counts: DataFrame, keys: list[str], shares: int = SHARES) -> DataFrame:
    """Hot keys and the number of parts to split each into. At most ``shares`` rows."""
    fair = counts.agg((F.sum("_rows") / F.lit(shares)).alias("f")).scalar()
    return counts.where(F.col("_rows") > fair).select(
        *keys, F.ceil(F.col("_rows") / fair).cast("int").alias("_parts")
    )


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    counts: DataFrame | None = None,
    shares: int = SHARES,
) -> DataFrame:
    """Join a large ``left`` to ``right`` with the hot keys of ``left`` split up.

    Rows of a hot key go to several parts by a hash of the whole row, and the
    matching rows of ``right`` are copied to each part. With ``right`` unique per
    key at most ``2 * shares`` extra rows exist. ``how`` is inner, left,
    left_semi or left_anti.
    Null keys match each other.
    """
    if counts is None:
        counts = key_counts(left, keys)
    hot = F.broadcast(hot_keys(counts, keys, shares))
    parts = F.coalesce("_parts", F.lit(1))
    spread = _with_null_keys(left, hot, keys, "left").withColumn(
        "_part", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), parts).cast("int")
    )
    copies = _with_null_keys(right, hot, keys, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), parts - 1))
    )
    return _with_null_keys(spread.drop("_parts"), copies.drop("_parts"), [*keys, "_part"], how).drop("_part")


def _with_null_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join in which null keys match; keys first, then the other columns of both sides."""
    renamed = right.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)]
    joined = left.join(renamed, functools.reduce(operator.and_, same), how).drop(*[f"_r{i}" for i in range(len(keys))])
    return joined.select(*keys, *[c for c in joined.columns if c not in keys])


def running_total(
    df: DataFrame, keys: list[str], levels: list[str], order: str, value: str, out: str
) -> DataFrame:
    """Inclusive running sum of ``value`` per ``keys`` in the order of ``levels`` then ``order``.

    ``levels`` are ever finer coarse forms of the order (day, then second). A
    window only ever sees the rows of one finest level, or the totals of one
    coarser level, so no window holds a whole key.
    """
    groups = [*keys, *levels]
    totals = [df.groupBy(*groups).agg(F.sum(value).alias("_t"))]
    for depth in range(len(levels) - 1, 0, -1):
        totals.insert(0, totals[0].groupBy(*keys, *levels[:depth]).agg(F.sum("_t").alias("_t")))

    shift = None
    for depth, total in enumerate(totals, 1):
        above = [*keys, *levels[: depth - 1]]
        before = (
            Window.partitionBy(*above).orderBy(levels[depth - 1])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        here = total.select(
            *above, levels[depth - 1], F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_shift")
        )
        shift = here if shift is None else _add_shift(here, shift, above, "_shift")

    within = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return _add_shift(df.withColumn(out, F.sum(value).over(within)), shift, groups, out)


def _add_shift(df: DataFrame, shift: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Add the shift of the row's group to ``target``; null keys match."""
    renamed = shift.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_shift").alias("_up"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = df.join(renamed, functools.reduce(operator.and_, same), "inner")
    return joined.withColumn(target, F.col(target) + F.col("_up")).select(*df.columns)


RANGES = 1024  # ranges that one pass of cut_off counts


def cut_off(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by the whole-number columns ``order``; all rows equal to the last one stay too.

    Nothing is sorted. Column by column the value at the cut is found by counting rows in at
    most RANGES equal ranges and going on with the range that holds the cut, so a pass sends the
    driver RANGES counts, whatever the table holds, and 64 bits take seven passes at most. Null
    values come last. The values of a column must lie within 2^63 of each other.
    """
    wanted, equal, left = F.lit(False), F.lit(True), n
    for name in order:
        here = df.where(equal).where(F.col(name).isNotNull())
        total, low, high = here.agg(F.count("*"), F.min(name), F.max(name)).first()
        if left <= 0 or total <= left:
            # All that have a value stay, and, if there is still room, those without.
            rest = F.col(name).isNotNull() if left == total else F.lit(left > 0)
            return df.where(wanted | (equal & rest))
        while low < high:
            width = (high - low) // RANGES + 1
            place = F.expr(f"(`{name}` - {low}L) div {width}L")
            counts = here.where(F.col(name).between(low, high)).groupBy(place.alias("r")).agg(F.count("*").alias("c")).collect()
            for r, c in sorted(map(tuple, counts)):
                if c >= left:
                    low, high = low + r * width, min(high, low + (r + 1) * width - 1)
                    break
                left -= c
        wanted = wanted | (equal & (F.col(name) < low))
        equal = equal & (F.col(name) == low)
    return df.where(wanted | equal)
