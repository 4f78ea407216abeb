"""Benchmark passages in training texts by spaced-seed hashes, substitutions tolerated."""

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpen.llm.common import keep_table, packed, row_keys, slices

WINDOW, SUBSTITUTIONS = 13, 2
# Scripts written without blanks: Thai to Tibetan, Myanmar, Khmer, Tai, kana, Bopomofo, ideographs and their extensions.
UNSPACED = (
    r"\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u1950-\u19DF\u1A20-\u1AAF\u3005-\u3007\u3021-\u3029\u3031-\u312F"
    r"\u31A0-\u31BF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uA9E0-\uA9FF\uAA60-\uAADF\uF900-\uFAFF\uFF66-\uFF9F"
    r"\U0001AFF0-\U0001B16F\U00020000-\U0003FFFF"
)
# Every letter of these scripts is a token, other letters and digits are tokens in runs.
TOKEN = re.compile(rf"(?=[{UNSPACED}])\w|[^\W{UNSPACED}]+")
FILTER_BITS = 26
FEW_ROWS = 128  # texts that become Python objects at a time
MOST_TOKENS = 1_000_000
MULTIPLIERS = np.array([xxhash.xxh64_intdigest(f"place {i}") | 1 for i in range(WINDOW)], np.uint64)


def masks() -> list[tuple[int, ...]]:
    """Kept places of the fixed masks. Each ignores two of four interleaved classes of places, so any
    two substituted tokens of a window are ignored by one of them."""
    return [tuple(p for p in range(WINDOW) if p % 4 not in ignored) for ignored in combinations(range(4), 2)]


def shapes(lengths: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """Window length and kept places of all seeds; ``lengths`` are the lengths of items below a window."""
    return [(WINDOW, m) for m in masks()] + [(n, tuple(range(n))) for n in sorted(lengths)]


class Hashes(dict):
    """Hashes of tokens already seen. One per task, so that nothing stays in the Python worker."""

    def __missing__(self, token):
        if len(self) >= MOST_TOKENS:
            self.clear()
        self[token] = n = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        return n


def token_hashes(text: str | None, seen: Hashes) -> np.ndarray:
    """Hashes of the lower-case tokens of a text."""
    return np.array([seen[t] for t in TOKEN.findall((text or "").lower())], np.uint64)


def seed_hashes(tokens: np.ndarray, number: int, shape: tuple[int, tuple[int, ...]]) -> np.ndarray:
    """Hash of every window under one seed."""
    length, kept = shape
    n = len(tokens) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, xxhash.xxh64_intdigest(f"seed {number}"), np.uint64)
    for p in kept:
        total += tokens[p : p + n] * MULTIPLIERS[p]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def _rows(found: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds)
    )


def benchmark_seeds(benchmark: DataFrame, seeds: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """Distinct seed windows of all items: hash, tokens, item_id (smallest that has the window)."""
    kinds = {"hash": pa.int64(), "tokens": pa.list_(pa.int64()), "item_id": pa.int64()}

    def run(batches):
        seen = Hashes()
        for batch in slices(batches, FEW_ROWS):
            found = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = token_hashes(text, seen)
                for number, shape in enumerate(seeds):
                    if shape[0] < WINDOW and len(tokens) != shape[0]:
                        continue  # short shapes are for whole items
                    for i, h in enumerate(seed_hashes(tokens, number, shape).view(np.int64).tolist()):
                        found.append((h, tokens[i : i + shape[0]].view(np.int64).tolist(), item_id))
            yield _rows(found, kinds)

    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    mapped = items.mapInArrow(run, "hash long, tokens array<long>, item_id long")
    return mapped.groupBy("hash", "tokens").agg(F.min("item_id").alias("item_id"))


def short_lengths(benchmark: DataFrame) -> list[int]:
    """Token counts of the items below a window; fewer than WINDOW values."""

    def run(batches):
        for batch in batches:
            sizes = {len(TOKEN.findall((t or "").lower())) for t in batch.column(0).to_pylist()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(sizes), pa.int32())], names=["n"])

    sizes = benchmark.select(F.col("text").cast("string")).mapInArrow(run, "n int")
    return [r.n for r in sizes.where((F.col("n") > 0) & (F.col("n") < WINDOW)).distinct().collect()]


def membership(seeds: DataFrame) -> np.ndarray:
    """Bit table of the seed hashes. Its size is fixed, whatever the benchmark: it only spares
    most documents the join, and a full table spares none."""
    place = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = (
        seeds.select(F.shiftright(place, 6).alias("word"), bit.alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return table


def find_overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified windows shared by documents and benchmark: _k1, _k2, doc_id, at, length, item_id, substitutions.

    Every window of 13 tokens is hashed under six masks, each of which ignores other places. A
    window counts if an item has a window that agrees up to two substituted tokens; items of
    fewer tokens, however few, must occur whole and unchanged. ``at`` and ``length`` are in tokens.

    Document windows meet benchmark windows in a join on the hash. A bit table of fixed size
    leaves out document windows that cannot meet any; no benchmark is too large for it.
    """
    seeds = shapes(short_lengths(benchmark))
    known = keep_table(benchmark_seeds(benchmark, seeds), "seeds")
    table = membership(known)
    kinds = {"_k1": pa.int64(), "_k2": pa.int64(), "doc_id": pa.int64(), "at": pa.int64(), "hash": pa.int64(),
             "own": pa.list_(pa.int64())}

    def run(batches):
        shift, low, seen = np.uint64(64 - FILTER_BITS), np.uint64(63), Hashes()
        for batch in slices(batches, FEW_ROWS):
            found = []
            for k1, k2, doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                tokens = token_hashes(text, seen)
                for number, shape in enumerate(seeds):
                    hashes = seed_hashes(tokens, number, shape)
                    place = hashes >> shift
                    hit = (table[place >> np.uint64(6)] >> (place & low)) & np.uint64(1)
                    for i in np.flatnonzero(hit):
                        own = tokens[i : i + shape[0]].view(np.int64).tolist()
                        found.append((k1, k2, doc_id, int(i), int(hashes[i].view(np.int64)), own))
            yield _rows(found, kinds)

    rows = documents.select(*row_keys(), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = rows.mapInArrow(run, "_k1 long, _k2 long, doc_id long, at long, hash long, own array<long>")
    met = windows.join(known, "hash").where(F.size("own") == F.size("tokens"))
    changed = F.size(F.filter(F.zip_with("own", "tokens", lambda a, b: a != b), lambda x: x))
    checked = met.withColumn("substitutions", changed).where(
        F.col("substitutions") <= F.when(F.size("own") < WINDOW, 0).otherwise(SUBSTITUTIONS)
    )
    return checked.select(
        "_k1", "_k2", "doc_id", "at", F.size("own").alias("length"), "item_id", "substitutions"
    )


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document that holds a benchmark passage: doc_id, n_windows, first_token, last_token, item_ids.

    ``item_ids`` names, for every shared window, the smallest item that has it. Null and empty
    texts and items share nothing. Repeated rows count as one document. A null doc_id is kept.
    Empty tables give an empty result. Columns other than doc_id, text and item_id are not read.
    """
    return (
        find_overlaps(documents, benchmark).groupBy("_k1", "_k2", "doc_id").agg(
            F.countDistinct("at", "length").alias("n_windows"), F.min("at").alias("first_token"),
            F.max(F.col("at") + F.col("length")).alias("last_token"),
            F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        ).drop("_k1", "_k2")
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those that hold a benchmark passage. All columns stay, whatever their names.

    Null and empty texts and items share nothing; repeated rows go or stay together, and a null
    doc_id is a row like any other; very long texts are searched whole; empty tables give what
    is left of ``documents``.
    """
    bad = find_overlaps(documents, benchmark).select("_k1", "_k2").distinct()
    return packed(documents).join(bad, ["_k1", "_k2"], "left_anti").select(
        *[F.col(f"_row.`{c}`").alias(c) for c in documents.columns]
    )
