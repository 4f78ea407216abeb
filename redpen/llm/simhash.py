"""Near duplicates by SimHash fingerprints, pivot distance tables and verified links."""

import functools
import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.llm.chosen_path import dense_candidates, exact_links, small_candidates
from redpen.llm.common import UPPER, keep_table, packed, row_keys, slices
from redpen.llm.components import components
from redpen.operators.skew import spread_join

BITS, DISTANCE = 64, 3
LOWER_TABLE = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
# Any two fingerprints that differ in at most three bits agree in three of six blocks.
BLOCKS = (11, 11, 11, 11, 10, 10)
# Buckets above this size are compared in square chunks, the others by a join.
FEW, CHUNK = 64, 2048
PIVOTS = 8
ROWS = 4096  # shingles whose bits are counted at a time
FEW_ROWS, FEW_SHINGLES = 128, 256  # rows that become Python objects, and shingles that are mixed, at a time
# Prints of shingle sets: the least hash under so many orders; bands of them are keys.
BAND, BANDS = 5, 30
MIXERS = np.array([xxhash.xxh64_intdigest(f"mixer {i}") | 1 for i in range(BAND * BANDS)], np.uint64)
SHIFTS = np.array([xxhash.xxh64_intdigest(f"shift {i}") for i in range(BAND * BANDS)], np.uint64)
# Wide prints of shingle sets: so many 64-bit words, and distances to so many reference prints.
WORDS, REFERENCES = 8, 32
WIDE = np.array([xxhash.xxh64_intdigest(f"word {i}") | 1 for i in range(WORDS)], np.uint64)
# A bit of two sets at the limit of 0.8 differs with a chance of 0.15 to 0.19, most for four shingles out of five.
DIFFERS, MISSED = 0.19, 1e-6


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def block_masks() -> list[int]:
    """One mask per choice of three blocks, as signed 64-bit numbers."""
    starts = np.cumsum((0, *BLOCKS))
    blocks = [((1 << b) - 1) << int(s) for s, b in zip(starts, BLOCKS, strict=False)]
    return [_signed(a | b | c) for a, b, c in combinations(blocks, len(BLOCKS) - DISTANCE)]


def pivots() -> list[int]:
    """Reference fingerprints: hashes of the first numbers."""
    return [_signed(xxhash.xxh64_intdigest(str(i).encode(), 42)) for i in range(PIVOTS)]


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of all shingles of the lower-cased words; of all words if they are fewer; none without words."""
    ws = (text or "").encode().translate(LOWER_TABLE).split()
    if not ws:
        return np.zeros(0, "<u8")
    joined = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws])
    starts = np.concatenate([[0], ends[:-1]])
    size = min(shingle, len(ws))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(ws) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
    return np.array([digest(joined[a:b], 42) for a, b in spans], "<u8")


def majority(words: np.ndarray) -> bytes:
    """Bits set in over half of the rows; rows are one or more 64-bit words."""
    ones = np.zeros(BITS * words.shape[1], np.int64)
    for at in range(0, len(words), ROWS):
        octets = np.ascontiguousarray(words[at : at + ROWS]).view(np.uint8).reshape(-1, 8 * words.shape[1])
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(words), bitorder="little").tobytes()


def fingerprint(text: str | None, shingle: int) -> int:
    """64 bits of a text; 0 without words."""
    return int.from_bytes(majority(shingle_hashes(text, shingle)[:, None]), "little")


def fingerprints(documents: DataFrame, shingle: int) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number."""

    def run(batches):
        for batch in batches:
            fps = [_signed(fingerprint(t, shingle)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, fp long"
    )


def pivot_table(fp: Column) -> Column:
    """Hamming distances to all pivots, a byte each in one number."""
    packed = F.lit(0).cast("long")
    for i, p in enumerate(pivots()):
        packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long"), 8 * i))
    return packed


def _near(a: Column, b: Column, table_a: Column, table_b: Column) -> Column:
    """The largest difference of pivot distances first, then the distance itself."""

    def at(table, i):
        return F.shiftright(table, 8 * i).bitwiseAND(F.lit(255))

    gaps = [F.abs(at(table_a, i) - at(table_b, i)) for i in range(PIVOTS)]
    return (F.greatest(*gaps) <= DISTANCE) & (F.bit_count(a.bitwiseXOR(b)) <= DISTANCE)


def spanning_links(fps: np.ndarray, tables: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all fingerprints within the distance, as few as it takes.

    Pairs whose pivot distances differ by more than the distance are discarded; only the
    others are compared bit by bit.
    """
    columns = tables.view(np.uint8).reshape(-1, 8).T.astype(np.int16)
    pairs = _spanning_pairs(fps.view(np.uint64)[:, None], columns, DISTANCE)
    return [(int(fps[i]), int(fps[j])) for i, j in pairs]


def _spanning_pairs(bits: np.ndarray, columns: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Row numbers of links within the distance that join all rows such links join.

    ``columns`` are the rows' distances to the pivots: two rows within the distance differ
    by no more than it in any of them.
    """
    group, links = np.arange(len(bits)), []
    for i in range(len(bits) - 1):
        gap = np.abs(columns[:, i + 1 :] - columns[:, i : i + 1]).max(0)
        rest = np.flatnonzero(gap <= distance) + i + 1
        rest = rest[np.bitwise_count(bits[rest] ^ bits[i]).sum(1) <= distance]
        names, first = np.unique(group[rest], return_index=True)
        other = names != group[i]
        links += [(i, int(j)) for j in rest[first[other]]]
        if other.any():
            group[np.isin(group, names[other])] = group[i]
    return links


def _squares(members: DataFrame, node: str) -> DataFrame:
    """Every member of a bucket of n once for each pair i, j of chunks that its own chunk is in."""
    chunks = F.ceil(F.col("n") / F.lit(CHUNK)).cast("int")
    own = F.pmod(F.xxhash64(node), chunks).cast("int")
    met = members.withColumn("_own", own).withColumn("_met", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return met.withColumns({"i": F.least("_own", "_met"), "j": F.greatest("_own", "_met")}).drop("_own", "_met")


def links(distinct: DataFrame) -> DataFrame:
    """Edges a, b that join all fingerprints of the column fp within the distance.

    Fingerprints meet under twenty keys of three blocks each. Buckets of few members give
    their pairs by a join. Larger buckets are cut into chunks by hash; every pair of chunks
    is compared in one task, which keeps spanning links only, so neither a bucket nor its
    pairs ever meet in one task.
    """
    keys = F.array(*[
        F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for i, m in enumerate(block_masks())
    ])
    members = distinct.select("fp", pivot_table(F.col("fp")).alias("table"), F.inline(keys))
    sizes = members.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keep_table(members.join(sizes, ["band", "key"]), "buckets")

    few = shared.where(F.col("n") <= FEW)
    other = few.select("band", "key", F.col("fp").alias("fp2"), F.col("table").alias("table2"))
    pairs = few.join(other, ["band", "key"]).where(
        (F.col("fp") < F.col("fp2")) & _near(F.col("fp"), F.col("fp2"), F.col("table"), F.col("table2"))
    ).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))

    squares = _squares(shared.where(F.col("n") > FEW), "fp").select("band", "key", "i", "j", "fp", "table")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        found = spanning_links(group.fp.to_numpy(np.int64), np.ascontiguousarray(group.table.to_numpy(np.int64)))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    crowded = squares.groupBy("band", "key", "i", "j").applyInPandas(compare, "a long, b long")
    return pairs.union(crowded)


def near_duplicates(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """Fingerprint and class of every document: doc_id, fingerprint, component_id.

    Texts are lower-cased (A-Z), words are cut at ASCII white space. ``component_id`` is the
    smallest doc_id that chains of links of at most three differing bits reach.

    Null and empty texts have fingerprint 0, linked like any other. Documents with equal
    fingerprints are one node, however many they are. Repeated rows are returned as often as
    they come in. A null doc_id never names a class, unless no other is there. An empty
    table gives an empty result. Columns other than doc_id and text are not read.
    """
    prints = keep_table(fingerprints(documents, shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = components(links(distinct.select("fp"))).withColumnsRenamed({"node": "fp"})
    named = distinct.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = named.join(classes, "root").select("fp", "component_id")
    return prints.join(names, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def set_print(shingles: np.ndarray) -> np.ndarray:
    """The least of the distinct shingle hashes under every order; two sets agree in a place as often as they are similar."""
    least = np.full(len(MIXERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), FEW_SHINGLES):
        np.minimum(least, ((shingles[at : at + FEW_SHINGLES, None] * MIXERS) ^ SHIFTS).min(0), out=least)
    return least


def wide_print(shingles: np.ndarray) -> bytes:
    """Every bit the majority over the distinct shingles of a bit of their mixed hashes."""
    mixed = shingles[:, None] * WIDE
    mixed = (mixed ^ mixed >> np.uint64(32)) * WIDE[::-1]
    return majority(mixed ^ mixed >> np.uint64(29))


def distinct_shingles(text: str | None, shingle: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(text, shingle))


def set_prints(documents: DataFrame, shingle: int) -> DataFrame:
    """Row keys, doc_id, and of the distinct shingles: node, the set's digest, size, keys, and print, their wide print."""

    def run(batches):
        for batch in slices(batches, FEW_ROWS):
            nodes, sizes, keys, prints = [], [], [], []
            for text in batch.column(3).to_pylist():
                own = distinct_shingles(text, shingle)
                nodes.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                least = set_print(own)
                bands = [least[i : i + BAND].tobytes() for i in range(0, len(least), BAND)] if len(own) else []
                keys.append([_signed(xxhash.xxh3_64_intdigest(b, i)) for i, b in enumerate(bands)])
                prints.append(wide_print(own))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(3)], pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(prints, pa.binary())],
                names=["_k1", "_k2", "doc_id", "node", "size", "keys", "print"],
            )

    rows = documents.select(*row_keys(), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        run, "_k1 long, _k2 long, doc_id long, node binary, size int, keys array<long>, print binary"
    )


def with_pivots(nodes: DataFrame) -> DataFrame:
    """Add ``sketch``: the wide print, then its Hamming distances to the reference prints, two bytes each.

    References are the prints of REFERENCES nodes chosen by hash, a bounded sample: a family of
    near copies that holds a good share of all nodes is among them, and its distances then set
    it apart from everything else.
    """
    rows = nodes.orderBy(F.xxhash64("node"), "node").limit(REFERENCES).select("print").collect()
    references = np.array([np.frombuffer(r[0], np.uint64) for r in rows]).reshape(-1, WORDS)

    def run(batches):
        for batch in batches:
            prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, WORDS)
            far = np.zeros((len(prints), REFERENCES), np.uint16)
            for i, reference in enumerate(references):
                far[:, i] = np.bitwise_count(prints ^ reference).sum(1)
            sketch = np.concatenate([prints.view(np.uint8).reshape(len(prints), -1), far.view(np.uint8)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in sketch], pa.binary())], names=["node", "sketch"])

    sketches = nodes.select("node", "print").mapInArrow(run, "node binary, sketch binary")
    return nodes.drop("print").join(sketches, "node")


def farthest_alike() -> int:
    """Bits in which the wide prints of a pair at the limit differ at most, but for the chance MISSED."""
    n, total = 64 * WORDS, 0.0
    for d in range(n, -1, -1):
        total += math.comb(n, d) * DIFFERS**d * (1 - DIFFERS) ** (n - d)
        if total > MISSED:
            return d
    return 0


def may_be_similar(sketch: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs of rows that set size, the largest difference of pivot distances, and then the prints leave."""
    far = farthest_alike()
    near = np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b])
    pivots_of = np.ascontiguousarray(sketch[:, 8 * WORDS :]).view(np.uint16).astype(np.int16)
    near[near] = np.abs(pivots_of[a[near]] - pivots_of[b[near]]).max(1) <= far
    prints = np.ascontiguousarray(sketch[:, : 8 * WORDS]).view(np.uint64)
    near[near] = np.bitwise_count(prints[a[near]] ^ prints[b[near]]).sum(1) <= far
    return near


def similar_links(documents: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """node and root of all nodes with a link: sets of at least the Jaccard similarity are linked.

    Nodes meet under thirty keys of five minwise values. In a bucket, tables of distances to
    reference prints discard pairs by their largest difference, the survivors' wide prints are
    compared, and only links that join what was not joined yet leave the task. The sets decide.
    """
    nodes = rows.where("size > 0").groupBy("node").agg(
        F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("print").alias("print"),
        F.min(F.struct("_k1", "_k2")).alias("row"),
    )
    nodes = keep_table(nodes, "nodes")
    members = nodes.select("node", F.explode("keys").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keep_table(spread_join(members, sizes, ["key"]), "buckets")
    met = nodes.join(shared.select("node").distinct(), "node", "left_semi")
    sketched = keep_table(with_pivots(met), "pivots")

    near = functools.partial(may_be_similar, similarity=similarity)
    small = small_candidates(shared.where(F.col("n") <= FEW).select("key", "node"), sketched, near)
    dense = dense_candidates(shared.where(F.col("n") > FEW).select("key", "n", "node"), sketched, near)
    shingles = functools.partial(distinct_shingles, shingle=shingle)
    return exact_links(documents, sketched, small.union(dense), shingles, similarity)


def drop_near_duplicates(documents: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``documents`` with one document left of every class of near duplicates, the one of the smallest doc_id.

    Documents are linked if the Jaccard similarity of their sets of word shingles is at least
    ``similarity``; how often a shingle occurs does not matter. Very long texts are compared
    whole; null and empty ones are without words; an empty table stays empty. A pair whose
    similarity is exactly 0.8 is missed with a chance of (1 - 0.8^5)^30 = 7 in a million by the
    keys and MISSED by the prints, unless others link it. All columns stay, whatever
    their names. Documents without words are one class. Of repeated rows one stays. A null
    doc_id stays only where a class has no other.
    """
    rows = keep_table(set_prints(documents, shingle), "prints")
    linked = similar_links(documents, rows, shingle, similarity)
    classed = rows.select("_k1", "_k2", "doc_id", "node").join(linked, "node", "left")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_k1", "_k2")
    best = classed.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(order).alias("b")).select("b._k1", "b._k2")
    kept = packed(documents).join(best, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in documents.columns])
