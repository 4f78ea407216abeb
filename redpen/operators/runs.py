"""Reports over run logs: ``run_id, call_id, rule_id, ts, ok, latency_ms``."""

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redpen.functions.text import hold
from redpen.operators.skew import running_total, spread_join

DAY_US = 86_400_000_000


def run_summary(calls: DataFrame) -> DataFrame:
    """Successes, failures, elapsed seconds and successes per second of each run."""
    us = F.unix_micros("ts")
    return (
        calls.groupBy("run_id")
        .agg(
            F.count_if("ok").alias("successes"),
            F.count_if(~F.col("ok")).alias("failures"),
            ((F.max(us) - F.min(us)) / 1e6).alias("elapsed_s"),
        )
        .withColumn("throughput", F.try_divide("successes", "elapsed_s"))
    )


def running_throughput(calls: DataFrame, every: int = 100) -> DataFrame:
    """Completions per second at each ``every``-th completion and at the end of a run.

    Calls are counted per run and instant first, so ties at one instant cost one
    row, and the running count goes over seconds and days, so no window holds a
    whole run.
    """
    us = F.unix_micros("ts")
    ticks = calls.groupBy("run_id", us.alias("us")).agg(F.count("*").alias("n"))
    ticks = ticks.withColumns(
        {"day": F.floor(F.col("us") / DAY_US), "second": F.floor(F.col("us") / 1_000_000)}
    )
    totals = running_total(ticks, ["run_id"], ["day", "second"], "us", "n", "done")
    runs = ticks.groupBy("run_id").agg(F.min("us").alias("start_us"), F.sum("n").alias("total"))
    joined = spread_join(totals, runs, ["run_id"])
    before = F.col("done") - F.col("n")
    first = (F.floor(before / every) + 1) * every
    marks = F.when(first <= F.col("done"), F.sequence(first, F.col("done"), F.lit(every).cast("bigint")))
    marks = F.coalesce(marks, F.array().cast("array<bigint>"))
    marks = F.when(
        (F.col("done") == F.col("total")) & (F.col("total") % every != 0),
        F.concat(marks, F.array("total")),
    ).otherwise(marks)
    elapsed = (F.col("us") - F.col("start_us")) / 1e6
    return joined.select(
        "run_id", F.explode_outer(marks).alias("completed"), elapsed.alias("elapsed_s")
    ).where(F.col("completed").isNotNull()).withColumn(
        "throughput", F.try_divide("completed", "elapsed_s")
    )


def failure_rates(
    calls: DataFrame, window_s: int = 60, min_calls: int = 10, threshold: float = 50.0,
    down_ms: int = 5000,
) -> DataFrame:
    """Failure rate of the last ``window_s`` seconds, per rule and second with calls.

    Calls are counted per rule and second first: a window then holds at most a few
    times ``window_s`` rows however many calls there are. Seconds are cut into
    chunks; the last ``window_s`` seconds of a chunk are copied to the next one as
    context. ``open`` tells that the breaker trips, ``down_until_ms`` until when.
    """
    chunk = window_s * 4
    counts = calls.groupBy(
        "rule_id", F.floor(F.unix_micros("ts") / 1_000_000).alias("second")
    ).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad"))
    own = F.floor(F.col("second") / chunk)
    # A second is context for the next chunk when that chunk starts within the window.
    spill = (own + 1) * chunk - F.col("second") < window_s
    homes = F.when(spill, F.array(own, own + 1)).otherwise(F.array(own))
    rows = counts.select("*", own.alias("own"), F.explode(homes).alias("home"))
    w = (
        Window.partitionBy("rule_id", "home").orderBy("second")
        .rangeBetween(-(window_s - 1), Window.currentRow)
    )
    rated = rows.select(
        "rule_id", "second", "own", "home",
        F.sum("n").over(w).alias("calls"), F.sum("bad").over(w).alias("failures"),
    ).where(F.col("own") == F.col("home"))
    rate = F.col("failures") * 100.0 / F.col("calls")
    tripped = (F.col("calls") >= min_calls) & (rate >= threshold)
    return rated.select(
        "rule_id", "second", "calls", "failures", rate.alias("failure_rate"),
        tripped.alias("open"),
        F.when(tripped, F.col("second") * 1000 + down_ms).alias("down_until_ms"),
    )


STATES = "rule_id string, second long, n long, bad long, counted boolean, calls long, failures long, tripped boolean, down_until_ms long"


def breaker_states(
    calls: DataFrame, window_s: int = 60, min_calls: int = 10, threshold: float = 50.0, down_ms: int = 5000
) -> DataFrame:
    """The breaker's own state at every rule and second with calls.

    Closed, it counts calls; when at least ``min_calls`` of the last ``window_s`` seconds fail at
    the rate ``threshold`` it trips, and for ``down_ms`` it is down: calls then are turned away and
    not counted. After that it is closed again with nothing counted. ``counted`` tells that the
    second's ``n`` calls went through, ``calls`` and ``failures`` what the window then holds,
    ``tripped`` that it trips there, ``down_until_ms`` until when it is down.

    A state depends on what came before, but a pause as long as the window and the down time
    wipes it out. So a rule is cut at its pauses, found by counting over time slices, and each
    stretch is walked alone, in order, with one window in memory. Calls are counted per second
    first, so a stretch without a pause has a row per second at most. A null rule is a rule;
    calls without a time are left out; a null ``ok`` is no failure.
    """
    pause = max(window_s, -(-down_ms // 1000)) + 1
    counts = calls.where(F.col("ts").isNotNull()).groupBy(
        "rule_id", F.floor(F.unix_micros("ts") / 1_000_000).alias("second")
    ).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad"))
    counts = counts.withColumn("slice", F.floor(F.col("second") / pause))
    slices = counts.groupBy("rule_id", "slice").agg(F.lit(1).alias("one"))
    # A slice without calls is at least a pause: the slice after it starts a stretch.
    before = slices.select(F.col("rule_id").alias("_rule"), (F.col("slice") + 1).alias("_next"), F.lit(0).alias("new"))
    met = slices.join(before, F.col("rule_id").eqNullSafe(F.col("_rule")) & (F.col("slice") == F.col("_next")), "left")
    marked = met.select(
        "rule_id", "slice", F.coalesce("new", F.lit(1)).alias("new"), F.floor(F.col("slice") / 4096).alias("block")
    )
    stretches = running_total(marked, ["rule_id"], ["block"], "slice", "new", "stretch").select("rule_id", "slice", "stretch")
    rows = spread_join(counts, stretches, ["rule_id", "slice"]).select("rule_id", "stretch", "second", "n", "bad")
    dealt = rows.repartition("rule_id", "stretch").sortWithinPartitions("rule_id", "stretch", "second")

    def walk(batches):
        at, window, down = None, deque(), None
        for batch in batches:
            out = []
            for rule, stretch, second, n, bad in batch.itertuples(index=False, name=None):
                if at != (rule, stretch):
                    at, window, down, held, failed = (rule, stretch), deque(), None, 0, 0
                counted = down is None or second * 1000 >= down
                tripped = False
                if counted:
                    down = None
                    window.append((second, n, bad))
                    held, failed = held + n, failed + bad
                    while window[0][0] <= second - window_s:
                        _, n_gone, bad_gone = window.popleft()
                        held, failed = held - n_gone, failed - bad_gone
                    tripped = held >= min_calls and failed * 100.0 / held >= threshold
                calls_now, failed_now = (held, failed) if counted else (0, 0)
                if tripped:
                    down, held, failed = second * 1000 + down_ms, 0, 0
                    window.clear()
                out.append((rule, second, n, bad, counted, calls_now, failed_now, tripped, down))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in STATES.split(", ")])
            yield frame.astype({"down_until_ms": "Int64"})

    return dealt.mapInPandas(walk, STATES)


def error_profile(matches: DataFrame, by: list[str]) -> DataFrame:
    """Counts over every combination of the columns ``by`` and their subtotals: the columns, ``total_<column>``, n.

    ``total_<column>`` tells that a row sums over the column, so a subtotal is never taken for
    rows whose value is null. Rows are counted per full combination first, so a value that
    holds most rows costs one row per task, and the subtotals are made of those counts alone.
    """
    counts = matches.groupBy(*by).agg(F.count("*").alias("n"))
    return counts.cube(*by).agg(
        *[(F.grouping(c) == 1).alias(f"total_{c}") for c in by], F.sum("n").alias("n")
    )


def agreement_masks(matches: DataFrame, column: str = "matches") -> DataFrame:
    """How often each set of correctors gave the same match: mask (a bit per corrector), n.

    A match is what merging takes for the same: offset, length and replacement. The set is made
    in the row by one sort, so neither matches nor pairs of them become rows before they are counted.
    """
    keyed = F.transform(
        F.coalesce(F.col(column), F.array().cast(matches.schema[column].dataType)),
        lambda m: F.struct(F.struct(m.offset, m.length, m.replacement).alias("key"), m.corrector_idx.alias("c")),
    )
    ordered = hold(matches.select(column), {"_s": F.array_sort(keyed)}).select("_s")
    first = F.filter(
        F.sequence(F.lit(0), F.size("_s")),
        lambda i: (i == 0) | (i == F.size("_s")) | ~F.get("_s", i).key.eqNullSafe(F.get("_s", i - 1).key),
    )
    ranged = hold(ordered.where(F.size("_s") > 0), {"_f": first})

    def mask(i: Column) -> Column:
        own = F.slice("_s", F.get("_f", i) + 1, F.get("_f", i + 1) - F.get("_f", i))
        bit = F.lit(1).cast("long")
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", bit, x.c.cast("int"))))

    masks = F.transform(F.sequence(F.lit(0), F.size("_f") - 2), mask)
    return ranged.select(F.explode(masks).alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))


def corrector_agreement(matches: DataFrame, correctors: int, column: str = "matches") -> DataFrame:
    """Corrector by corrector: a, b, both (matches that both gave), n_a, n_b, expected, agreement.

    ``expected`` is what two correctors of these sizes would share by chance, ``agreement`` the
    share of either's matches that both gave. With ``a`` equal to ``b``, ``both`` is how many that
    corrector gave. At most 62 correctors: the counted sets are the only rows.
    """
    if correctors > 62:
        raise ValueError("a set of correctors is a 64-bit number: 62 correctors at most")
    masks = agreement_masks(matches, column)
    pairs = F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b")) for i in range(correctors) for j in range(correctors)])
    each = masks.select("n", "mask", F.inline(pairs))

    def has(c: str) -> Column:
        return F.call_function("shiftright", F.col("mask"), F.col(c)).bitwiseAND(F.lit(1)) == 1

    summed = each.groupBy("a", "b").agg(
        F.coalesce(F.sum(F.when(has("a") & has("b"), F.col("n"))), F.lit(0)).alias("both"),
        F.coalesce(F.sum(F.when(has("a"), F.col("n"))), F.lit(0)).alias("n_a"),
        F.coalesce(F.sum(F.when(has("b"), F.col("n"))), F.lit(0)).alias("n_b"), F.sum("n").alias("_all"),
    )
    return summed.select(
        "a", "b", "both", "n_a", "n_b", F.try_divide(F.col("n_a") * F.col("n_b"), "_all").alias("expected"),
        F.try_divide("both", F.col("n_a") + F.col("n_b") - F.col("both")).alias("agreement"),
    )


def latency_percentiles(
    calls: DataFrame, points: list[float], value: str = "latency_ms", key: str = "rule_id",
    accuracy: int = 1000,
) -> DataFrame:
    """Exact interpolated percentiles per key, with the count and the maximum.

    An approximate quantile sketch brackets each rank; only values inside the
    bracket are counted one by one. No aggregate holds all values of a key.
    """
    slack = 2.0 / accuracy
    bounds = [min(max(p + d, 0.0), 1.0) for p in points for d in (-slack, slack)]
    sketch = calls.where(F.col(value).isNotNull()).groupBy(key).agg(
        F.count("*").alias("_n"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
        F.percentile_approx(value, bounds, accuracy).alias("_b"),
    )
    # Small keys are counted whole; for larger ones the slack covers both ranks.
    small = F.col("_n") <= 10 * accuracy
    brackets = F.array(
        *[
            F.struct(
                F.lit(p).alias("p"),
                F.when(small | F.lit(p <= slack), F.col("_min"))
                .otherwise(F.get("_b", F.lit(2 * i))).alias("lo"),
                F.when(small | F.lit(p >= 1 - slack), F.col("_max"))
                .otherwise(F.get("_b", F.lit(2 * i + 1))).alias("hi"),
                (F.lit(p) * (F.col("_n") - 1)).alias("at"),
            )
            for i, p in enumerate(points)
        ]
    )
    targets = sketch.select(key, "_n", "_max", F.explode(brackets).alias("t")).select(
        key, "_n", "_max", "t.*"
    )
    per_key = targets.groupBy(key).agg(
        F.collect_list(F.struct("p", "lo", "hi")).alias("_ts")
    )
    # Below a bracket only the number of rows matters; above it nothing does.
    # The sketch has one row per key and the calls are counted per key and value
    # before they meet, so a hot key does not gather its calls anywhere.
    values = calls.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(
        F.count("*").alias("c")
    )
    hits = spread_join(values, per_key, [key]).select(
        key, "v", "c", F.explode("_ts").alias("t")
    ).select(key, "v", "c", F.col("t.p").alias("p"), F.col("t.lo").alias("lo"), F.col("t.hi").alias("hi"))
    inside = hits.where(F.col("v") <= F.col("hi")).withColumn(
        "v", F.when(F.col("v") >= F.col("lo"), F.col("v"))
    ).groupBy(key, "p", "v").agg(F.sum("c").alias("c"))
    w = Window.partitionBy(key, "p").orderBy(F.asc_nulls_first("v"))
    cum = inside.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    known = targets.select(F.col(key).alias("_key"), F.col("p").alias("_p"), "at", "_n", "_max")
    placed = cum.join(known, F.col(key).eqNullSafe(F.col("_key")) & (F.col("p") == F.col("_p"))).drop("_key", "_p")

    def value_at(rank):
        here = (F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto")) & F.col("v").isNotNull()
        return F.max(F.when(here, F.col("v")))

    low, high = F.floor("at"), F.ceil("at")
    picked = placed.groupBy(key, "p").agg(
        value_at(low).alias("a"), value_at(high).alias("b"),
        F.max("at").alias("at"), F.max("_n").alias("n"), F.max("_max").alias("max"),
    )
    return picked.select(
        key, F.col("p").alias("point"), "n", "max",
        (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("value"),
    )


def matches_per(matches: DataFrame, keys: list[str]) -> DataFrame:
    return matches.groupBy(*keys).agg(F.count("*").alias("n_matches"))


def micro_batches(df: DataFrame, index: str, size: int = 8, out: str = "batch") -> DataFrame:
    """Number fixed-size batches from a dense 0-based index, e.g. the sentence index."""
    return df.withColumn(out, F.floor(F.col(index) / size))


def repeat_consistency(results: DataFrame, text: str = "text", digest: str = "digest") -> DataFrame:
    """Per text, how often it was checked and whether every result was the same."""
    return results.groupBy(text).agg(
        F.count("*").alias("n"), (F.min(digest).eqNullSafe(F.max(digest))).alias("consistent")
    )
