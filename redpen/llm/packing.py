"""Packing token sequences by fitted length patterns."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redpen.llm.common import keep_table, slices
from redpen.llm.tokens import word_bpe

FEW_ROWS = 128  # texts that become Python objects at a time
PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"
)


def cut_pieces(
    documents: DataFrame, capacity: int, tokenizer: str, end_id: int
) -> DataFrame:
    """Token pieces of all documents, with a rank among the pieces of the same length in the same task.

    The ranks stay as they are once the table is written, so write it before using them.
    """

    def run(batches):
        encode = word_bpe(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in slices(batches, FEW_ROWS):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(own), part, seen[n]))
                    seen[n] += 1
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
                )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def patterns(capacity: int) -> np.ndarray:
    """Patterns of one to four lengths that fill a sequence exactly; unused places are 0.

    All pairs, and for every length a few splits of the rest into two or three parts.
    Their number depends on the capacity only.
    """
    first = np.arange(1, capacity)
    rest = capacity - first
    zero = np.zeros_like(first)
    found = [np.array([[capacity, 0, 0, 0]]), np.stack([first, rest, zero, zero], 1)]
    for parts in (2, 3, 4, 6, 8, 12):
        a = rest // parts
        found.append(np.stack([first, a, rest - a, zero], 1)[a > 0])
    for one, two in ((3, 3), (4, 4), (4, 2), (6, 3), (8, 4), (8, 8)):
        a, b = rest // one, rest // two
        found.append(np.stack([first, a, b, rest - a - b], 1)[(a > 0) & (b > 0) & (a + b < rest)])
    return np.unique(np.sort(np.concatenate(found), 1), axis=0)


def fit_counts(histogram: np.ndarray, shapes: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts of the patterns by non-negative least squares against the histogram.

    ``histogram`` counts the pieces of each length from 0. Long pieces weigh more, since
    short ones find a place anywhere. Accelerated projected gradient steps.
    """
    weight = np.arange(len(histogram)) / (len(histogram) - 1)
    goal = histogram * weight
    value = np.where(shapes > 0, weight[shapes], 0.0)

    def forward(x):
        return np.bincount(shapes.ravel(), (value * x[:, None]).ravel(), len(histogram))

    def backward(r):
        return (r[shapes] * value).sum(1)

    v = np.ones(len(shapes))
    for _ in range(30):
        v = backward(forward(v))
        size = np.linalg.norm(v)
        v /= size
    step = 1 / (1.05 * size)
    x, y, t = np.zeros(len(shapes)), np.zeros(len(shapes)), 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * backward(forward(y) - goal))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_bins(histogram: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal sequences as (number of sequences, [(length, pieces of it), ...]).

    Patterns first: counts are rounded, and lowered where the pieces do not suffice. The
    rest goes by best fit, longest first, in whole groups of equal sequences.
    """
    capacity, left, groups = len(histogram) - 1, histogram.astype(np.int64).copy(), []
    shapes = patterns(capacity)
    present = ((shapes == 0) | (left[shapes] > 0)).all(1)
    shapes = shapes[present]
    if len(shapes):
        counts = np.rint(fit_counts(histogram, shapes)).astype(np.int64)
        for i in np.argsort(-counts, kind="stable"):
            if counts[i] <= 0:
                break
            need = Counter(int(n) for n in shapes[i] if n)
            count = min(int(counts[i]), *(int(left[n]) // m for n, m in need.items()))
            if count:
                groups.append((count, sorted(need.items(), reverse=True)))
                for n, m in need.items():
                    left[n] -= count * m
    return groups + _best_fit(left)


def _best_fit(left: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    capacity = len(left) - 1
    by_space, open_spaces = defaultdict(list), np.zeros(capacity + 1, bool)

    def put(count, items, space):
        by_space[space].append((count, items))
        open_spaces[space] = True

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fitting = np.flatnonzero(open_spaces[length:])
            if len(fitting):
                space = length + int(fitting[0])
                count, items = by_space[space].pop()
                open_spaces[space] = bool(by_space[space])
                each = min(space // length, n // count) or 1
                used = min(count, n)
                put(used, [*items, (length, each)], space - each * length)
                if used < count:
                    put(count - used, items, space)
                n -= used * each
            else:
                each = min(capacity // length, n)
                count = n // each
                put(count, [(length, each)], capacity - each * length)
                n -= count * each
    return [group for groups in by_space.values() for group in groups]


def places(groups: list[tuple[int, list[tuple[int, int]]]]) -> pd.DataFrame:
    """Where the pieces of each length go: runs of ranks with their first sequence and offset."""
    rows, next_rank, sequence = [], Counter(), 0
    for count, items in groups:
        offset = 0
        for length, each in items:
            rows.append((length, next_rank[length], each, sequence, offset))
            next_rank[length] += count * each
            offset += each * length
        sequence += count
    return pd.DataFrame(rows, columns=["length", "first_rank", "each", "sequence", "offset"]).sort_values(
        ["length", "first_rank"], ignore_index=True
    )


def pack_documents(
    documents: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 1
) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only
    documents longer than the capacity are cut. Every document ends in ``end_id``, so null
    and empty texts have one token. Repeated rows are packed as often as they come in; an
    empty table gives an empty result; a null doc_id is kept. Columns other than doc_id
    and text are not read.

    The driver sees one count per length, at most ``capacity``, and plans groups of equal
    sequences. Pieces are numbered within their length without any shuffle of a length as a
    whole: a rank within the task plus the number of such pieces in earlier tasks.
    """
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    pieces = keep_table(cut_pieces(documents, capacity, tokenizer, end_id), "pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row per length
        histogram[row.length] = row.n
    where = places(plan_bins(histogram))
    keys = where.length.to_numpy(np.int64) << 44 | where.first_rank.to_numpy(np.int64)
    table = where[["first_rank", "each", "sequence", "offset"]].to_numpy(np.int64)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        ranks = rank.to_numpy(np.int64)
        lengths = length.to_numpy(np.int64)
        first, each, sequence, offset = table[np.searchsorted(keys, lengths << 44 | ranks, "right") - 1].T
        nth, within = np.divmod(ranks - first, each)
        return pd.DataFrame({"sequence_id": sequence + nth, "offset": offset + within * lengths})

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    placed = pieces.join(shifts, ["part", "length"]).withColumn(
        "place", place("length", F.col("local_rank") + F.col("shift"))
    )
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
