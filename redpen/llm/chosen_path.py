"""Near duplicates by chosen paths: documents branch by minwise values until few are left together."""

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.llm.common import UPPER, keep_table, row_keys, slices
from redpen.llm.components import components
from redpen.operators.skew import spread_join

LOWER_TABLE = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
# Whether pairs of rows (a, b) of sketches and set sizes may be similar enough.
Alike = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
PLACES = 128  # minwise values of a set; all may be chosen, and all are the sketch
MIXERS = np.array([xxhash.xxh64_intdigest(f"path mixer {i}") | 1 for i in range(PLACES)], np.uint64)
SHIFTS = np.array([xxhash.xxh64_intdigest(f"path shift {i}") for i in range(PLACES)], np.uint64)
PAIR = [np.uint64(xxhash.xxh64_intdigest(f"pair {i}") | 1) for i in range(3)]
LONE = np.uint64(xxhash.xxh64_intdigest("lone word"))
FEW = 64  # a node of so many sets or fewer is compared exhaustively where it is
BRANCHES, LEVELS = 3, 5  # places chosen at a larger node, and levels after the first
CHUNK = 2048  # sets of a part of a node that does not split
CHUNK_BYTES = 4 << 20  # shingles of a part of a cluster
MISSED = 1e-6  # chance that the sketches of a pair at the limit look too different
FEW_ROWS, FEW_SHINGLES = 128, 256  # rows that become Python objects, and shingles that are mixed, at a time
MOST_WORDS = 500_000  # remembered word hashes of one Python worker


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 7)
        return value


_WORDS = _Hashes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the two-word shingles; of the word if it is alone; none without words."""
    ws = (text or "").encode().translate(LOWER_TABLE).split()
    own = np.fromiter(map(_WORDS.__getitem__, ws), np.uint64, len(ws))
    if len(own) < 2:
        return own ^ LONE
    mixed = own[:-1] * PAIR[0] ^ (own[1:] * PAIR[1] >> np.uint64(29) | own[1:] * PAIR[1] << np.uint64(35))
    mixed = (mixed ^ mixed >> np.uint64(32)) * PAIR[2]
    return np.unique(mixed ^ mixed >> np.uint64(29))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The least of the mixed hashes under every mixer; two sets agree in a place as often as they are similar."""
    least = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), FEW_SHINGLES):
        np.minimum(least, ((shingles[at : at + FEW_SHINGLES, None] * MIXERS) ^ SHIFTS).min(0), out=least)
    return least


def sketches(documents: DataFrame) -> DataFrame:
    """Row keys, doc_id, node (digest of the set), size, values (four bytes a place) and sketch (one byte a place)."""

    def run(batches):
        for batch in slices(batches, FEW_ROWS):
            nodes, sizes, values, bytes_ = [], [], [], []
            for text in batch.column(3).to_pylist():
                own = shingle_set(text)
                least = minwise(own)
                nodes.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                values.append(least.astype("<u4").tobytes())
                bytes_.append(least.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(3)], pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()),
                 pa.array(values, pa.binary()), pa.array(bytes_, pa.binary())],
                names=["_k1", "_k2", "doc_id", "node", "size", "values", "sketch"],
            )

    rows = documents.select(*row_keys(), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        run, "_k1 long, _k2 long, doc_id long, node binary, size int, values binary, sketch binary"
    )


def trees_for(recall: float, similarity: float) -> int:
    """Independent trees that meet a pair at the limit with the wanted chance.

    A pair stays together at the root's one place with the chance ``similarity``, and below
    it at one of the branches at least, level by level.
    """
    below = 1.0
    for _ in range(LEVELS):
        below = 1 - (1 - similarity * below) ** BRANCHES
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity * below)))


def fewest_equal(similarity: float) -> int:
    """Equal bytes that the sketches of a pair at the limit have, but for the chance MISSED."""
    p, total = similarity + (1 - similarity) / 256, 0.0
    for n in range(PLACES + 1):
        total += math.comb(PLACES, n) * p**n * (1 - p) ** (PLACES - n)
        if total > MISSED:
            return n
    return PLACES


def first_level(nodes: DataFrame, trees: int) -> DataFrame:
    """key and node: every tree deals all sets out by the minwise value of its own place."""
    keys = [F.xxhash64(F.lit(t), F.substring("values", 4 * t + 1, 4)) for t in range(trees)]
    return nodes.select("node", F.explode(F.array(*keys)).alias("key"))


def next_level(members: DataFrame) -> DataFrame:
    """parent, key and node: every node chooses its places by its own hash, and deals its sets out by each."""
    chosen = members.withColumn("_branch", F.explode(F.array(*[F.lit(i) for i in range(BRANCHES)])))
    placed = chosen.withColumn("_place", F.pmod(F.xxhash64("key", "_branch"), F.lit(PLACES)).cast("int"))
    value = F.expr("substring(values, 4 * _place + 1, 4)")
    return placed.select(F.col("key").alias("parent"), F.xxhash64("key", "_branch", value).alias("key"), "node")


def _sizes(members: DataFrame, *more: str) -> DataFrame:
    return members.groupBy(*more, "key").agg(F.count("*").alias("n")).where("n > 1")


def grow(nodes: DataFrame, trees: int) -> tuple[DataFrame, DataFrame]:
    """Small nodes and dense ones: key and node, and key, n and node.

    A node of few sets is small. A larger one branches; if a branch keeps more than half of it
    together, choosing more places would copy it rather than split it, and it is dense. What is
    still large after the last level is dense too, so no set is ever given up.
    """
    level = first_level(nodes, trees)
    shared = keep_table(spread_join(level, _sizes(level), ["key"]), "paths")
    small, dense = [shared.where(F.col("n") <= FEW).select("key", "node")], []
    large = shared.where(F.col("n") > FEW).select("key", "n", "node")
    for depth in range(LEVELS):
        if large.isEmpty():
            break
        if depth == LEVELS - 1:
            dense.append(large)
            break
        branched = next_level(large.join(nodes.select("node", "values"), "node"))
        sizes = keep_table(_sizes(branched, "parent"), "sizes")
        most = sizes.groupBy("parent").agg(F.max("n").alias("most")).withColumnRenamed("parent", "key")
        judged = spread_join(large, most, ["key"], "left")
        whole = F.coalesce(2 * F.col("most") > F.col("n"), F.lit(False))
        judged = keep_table(judged.withColumn("dense", whole), "judged")
        dense.append(judged.where("dense").select("key", "n", "node"))
        split = next_level(judged.where("NOT dense").join(nodes.select("node", "values"), "node")).select("key", "node")
        shared = keep_table(spread_join(split, sizes.select("key", "n"), ["key"]), "paths")
        small.append(shared.where(F.col("n") <= FEW).select("key", "node"))
        large = shared.where(F.col("n") > FEW).select("key", "n", "node")
    return _union(small), _union(dense) if dense else large.limit(0)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


class _Groups(dict):
    """Row numbers and the first row of their group so far."""

    def __missing__(self, row: int) -> int:
        return row

    def find(self, row: int) -> int:
        while (above := self[row]) != row:
            self[row] = self[above]
            row = above
        return row

    def merge(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)
        return a != b


def alike(bits: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the pairs of rows a, b may have the similarity, by set size and sketch."""
    near = np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b])
    near[near] = (bits[a[near]] == bits[b[near]]).sum(1) >= fewest_equal(similarity)
    return near


def small_candidates(small: DataFrame, nodes: DataFrame, alike: Alike) -> DataFrame:
    """Pairs a, b that join all sets whose sketches are alike in a small node, as few as it takes.

    Members of a node lie beside each other after the sort; all nodes of a batch are compared at once.
    """

    def pairs(table: pa.Table) -> pa.RecordBatch:
        keys, sizes = table["key"].to_numpy(), table["size"].to_numpy()
        bits = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(keys), -1)
        ones, twos = [], []
        for gap in range(1, FEW):
            a = np.flatnonzero(keys[gap:] == keys[:-gap])
            if not len(a):
                break
            near = alike(bits, sizes, a, a + gap)
            ones.append(a[near])
            twos.append(a[near] + gap)
        groups = _Groups()
        kept = [
            (i, j) for i, j in zip(np.concatenate(ones or [[]]).tolist(), np.concatenate(twos or [[]]).tolist(), strict=True)
            if groups.merge(int(i), int(j))
        ]
        names = table["node"]
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array([int(p[k]) for p in kept], pa.int64())).combine_chunks() for k in (0, 1)], names=["a", "b"]
        )

    def run(batches) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if waiting is None else pa.concat_tables([waiting, table])
            keys = table["key"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last node may go on
            waiting = table.slice(cut)
            if cut:
                yield pairs(table.slice(0, cut))
        if waiting is not None and len(waiting):
            yield pairs(waiting)

    met = small.join(nodes.select("node", "size", "sketch"), "node").repartition("key").sortWithinPartitions("key")
    return met.select("key", "node", "size", "sketch").mapInArrow(run, "a binary, b binary")


def in_squares(members: DataFrame, parts: Column) -> DataFrame:
    """Every member once for each pair i, j of the parts of its group that its own part, by hash, is in."""
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    met = members.withColumn("_own", own).withColumn("_met", F.explode(F.sequence(F.lit(0), parts - 1)))
    return met.withColumns({"i": F.least("_own", "_met"), "j": F.greatest("_own", "_met")}).drop("_own", "_met")


def spanning(count: int, linked) -> list[tuple[int, int]]:
    """Links that join all of ``count`` rows that chains of links join. ``linked(i, rest)`` gives the rows of rest linked to i.

    Every row is compared only with those that no chain has reached yet.
    """
    left, found = np.arange(count), []
    while len(left):
        waiting, left = [int(left[0])], left[1:]
        while waiting and len(left):
            i = waiting.pop()
            near = linked(i, left)
            found += [(i, int(j)) for j in left[near]]
            waiting += left[near].tolist()
            left = left[~near]
    return found


def dense_candidates(dense: DataFrame, nodes: DataFrame, alike: Alike) -> DataFrame:
    """Pairs a, b that join all sets whose sketches are alike in a dense node, by squares of parts of it."""
    parts = F.ceil(F.col("n") / F.lit(CHUNK)).cast("int")
    met = in_squares(dense, parts).join(nodes.select("node", "size", "sketch"), "node")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        names, sizes = group.node.to_numpy(), group["size"].to_numpy()
        bits = np.frombuffer(b"".join(group.sketch), np.uint8).reshape(len(group), -1)

        def linked(i, rest):
            return alike(bits, sizes, np.full(len(rest), i), rest)

        return pd.DataFrame([(names[i], names[j]) for i, j in spanning(len(group), linked)], columns=["a", "b"], dtype="object")

    return met.select("key", "i", "j", "node", "size", "sketch").groupBy("key", "i", "j").applyInPandas(compare, "a binary, b binary")


def sets_of(documents: DataFrame, chosen: DataFrame, shingles: Callable[[str | None], np.ndarray]) -> DataFrame:
    """root, node, parts and hashes, the sorted shingle hashes, of the rows in ``chosen`` (_k1, _k2, node, root, parts)."""

    def run(batches):
        for batch in slices(batches, FEW_ROWS):
            sets = [shingles(t).tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(3)], pa.array(sets, pa.binary())], names=["root", "node", "parts", "hashes"]
            )

    rows = documents.select(*row_keys(), F.col("text").cast("string").alias("text")).dropDuplicates(["_k1", "_k2"])
    met = rows.join(chosen, ["_k1", "_k2"]).select("root", "node", "parts", "text")
    return met.mapInArrow(run, "root binary, node binary, parts int, hashes binary")


def confirmed(sets: DataFrame, similarity: float) -> DataFrame:
    """Links a, b between sets of a cluster with at least the similarity, as few as join all that such links join.

    Clusters are cut into parts of bounded bytes, and every pair of parts is one group.
    """

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        names = group.node.to_numpy()
        own = [np.frombuffer(h, "<u8") for h in group.hashes]
        sizes, ends = np.array([len(s) for s in own]), np.cumsum([0, *[len(s) for s in own]])
        codes = np.unique(np.concatenate(own), return_inverse=True)[1]
        has = np.zeros(int(codes.max()) + 1, bool)

        def linked(i, rest):
            near = np.minimum(sizes[rest], sizes[i]) >= similarity * np.maximum(sizes[rest], sizes[i])
            has[:] = False
            has[codes[ends[i] : ends[i + 1]]] = True
            if np.count_nonzero(near) > FEW:
                common = np.add.reduceat(has[codes], ends[:-1], dtype=np.int64)[rest]
                return near & (common >= similarity * (sizes[i] + sizes[rest] - common) - 1e-9)
            for k in np.flatnonzero(near):
                j = rest[k]
                common = np.count_nonzero(has[codes[ends[j] : ends[j + 1]]])
                near[k] = common >= similarity * (sizes[i] + sizes[j] - common) - 1e-9
            return near

        return pd.DataFrame([(names[i], names[j]) for i, j in spanning(len(own), linked)], columns=["a", "b"], dtype="object")

    squares = in_squares(sets, F.col("parts")).select("root", "i", "j", "node", "hashes")
    return squares.groupBy("root", "i", "j").applyInPandas(compare, "a binary, b binary")


def exact_links(
    documents: DataFrame, nodes: DataFrame, candidates: DataFrame, shingles: Callable[[str | None], np.ndarray], similarity: float
) -> DataFrame:
    """node and root of all nodes that links join; candidates only propose, the sets decide.

    ``candidates`` (a, b) join all pairs that may be similar. Their components are compared
    set by set, each set once for every part its cluster has, so no pair is ever a row.
    """
    clusters = keep_table(components(candidates), "clusters")
    sized = clusters.join(nodes.select("node", "size", "row"), "node")
    bytes_ = sized.groupBy("root").agg(F.ceil(8 * F.sum("size") / F.lit(CHUNK_BYTES)).cast("int").alias("parts"))
    chosen = spread_join(sized.select("root", "node", "row"), bytes_, ["root"]).select("root", "node", "parts", "row.*")
    return components(confirmed(keep_table(sets_of(documents, chosen, shingles), "sets"), similarity))


def near_duplicates(documents: DataFrame, similarity: float = 0.8, recall: float = 0.99999) -> DataFrame:
    """Class of every document by the similarity of its set of two-word shingles: doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z), words are cut at ASCII white space. Documents are linked if the
    Jaccard similarity of their sets is at least ``similarity``; ``component_id`` is the smallest
    doc_id that chains of links reach. A pair at the limit is missed with a chance of at most
    1 - ``recall`` by the trees and MISSED by the sketches; every link is confirmed on the sets.

    A text of one word is a set of that word. Null and empty texts have empty sets, linked with
    nothing. Equal sets are one node, however many documents have them. Repeated rows are returned
    as often as they come. A null doc_id names a class only if no other is there. Very long texts
    are compared whole. An empty table gives an empty result. Columns other than doc_id and text
    are not read.
    """
    rows = keep_table(sketches(documents), "sketches")
    nodes = rows.where("size > 0").groupBy("node").agg(
        F.first("size").alias("size"), F.first("values").alias("values"), F.first("sketch").alias("sketch"),
        F.min(F.struct("_k1", "_k2")).alias("row"),
    )
    nodes = keep_table(nodes, "nodes")
    small, dense = grow(nodes, trees_for(recall, similarity))
    near = functools.partial(alike, similarity=similarity)
    candidates = small_candidates(small, nodes, near).union(dense_candidates(dense, nodes, near))
    linked = exact_links(documents, nodes, candidates, shingle_set, similarity)

    ids = rows.groupBy("node", "size").agg(F.min("doc_id").alias("least"))
    classed = ids.where("size > 0").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = spread_join(classed.select("root", "node"), names, ["root"]).select("node", "component_id")
    own = rows.where("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    others = spread_join(rows.where("size > 0").select("node", "doc_id", "size"), named, ["node"])
    return others.select("doc_id", "size", "component_id").union(own).select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
