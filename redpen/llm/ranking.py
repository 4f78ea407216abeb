"""Ranked lexical search: blocks of an inverted index, skipped by bounds of terms and of pairs of terms."""

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redpen.llm.common import UPPER, keep_table, slices

# Terms are runs of ASCII letters, digits and all bytes above ASCII; other bytes become blanks.
FOLD = bytes(
    b + 32 if chr(b) in UPPER else b if b > 127 or chr(b).isalnum() else 32 for b in range(256)
)
FEW_ROWS = 256  # rows that become Python objects at a time
BLOCK_ROWS, BLOCK_POSTINGS = 4096, 1_000_000  # a block of the index is closed beyond one of these
ITEM_BYTES = 16 << 20  # item texts that one pass over the documents answers; more items take more passes

POSTINGS = (
    "block long, docs array<long>, n binary, terms binary, starts binary, entries binary, tf binary, rows long, words long"
)
INDEX = (
    "docs array<long>, terms binary, starts binary, entries binary, impacts binary, maxima binary,"
    " pairs binary, joint binary"
)


def terms_of(text: str | None) -> list[bytes]:
    """All terms of a text in order, as UTF-8."""
    return (text or "").encode().translate(FOLD).split()


class Items:
    """A bounded block of items: their terms as numbers, with counts, and the pairs whose lists are kept."""

    def __init__(self, rows: list[tuple]):
        counted = [(item_id, Counter(terms_of(text))) for item_id, text in rows]
        self.ids = [item_id for item_id, _ in counted]
        self.vocabulary = {t: i for i, t in enumerate(sorted(set().union(*[c for _, c in counted])))}
        self.counts = [{self.vocabulary[t]: n for t, n in c.items()} for _, c in counted]
        self.weights = np.zeros(len(self.vocabulary), np.int64)
        self.groups: list[list[tuple[int, ...]]] = []
        self.pairs: list[tuple[int, int]] = []

    def weigh(self, documents: int, frequencies: dict[int, int]) -> None:
        """Weights of all terms; every item's terms are then paired, heavy ones with heavy ones."""
        for t, df in frequencies.items():
            self.weights[t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        for counts in self.counts:
            heavy = sorted((t for t in counts if self.weights[t] > 0), key=lambda t: (-self.weights[t], t))
            self.groups.append([tuple(sorted(heavy[i : i + 2])) for i in range(0, len(heavy), 2)])
        self.pairs = sorted({g for groups in self.groups for g in groups if len(g) == 2})


def postings(documents: DataFrame, items: Items) -> DataFrame:
    """Blocks of documents with the postings of all item terms, term by term; ``rows`` and ``words`` count whole texts."""
    vocabulary = documents.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches):
        known, number, block = vocabulary.value, 0, _Block()
        for batch in slices(batches, FEW_ROWS):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block.add(doc_id, terms_of(text), known)
                if len(block.docs) >= BLOCK_ROWS or len(block.terms) >= BLOCK_POSTINGS:
                    yield block.row((TaskContext.get().partitionId() << 32) + number)
                    number, block = number + 1, _Block()
        if block.rows:
            yield block.row((TaskContext.get().partitionId() << 32) + number)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, POSTINGS)


class _Block:
    def __init__(self):
        self.docs, self.n, self.terms, self.entries, self.tf = [], [], [], [], []
        self.rows = self.words = 0

    def add(self, doc_id: int | None, terms: list[bytes], known: dict[bytes, int]) -> None:
        self.rows += bool(terms)
        self.words += len(terms)
        counts = Counter(terms)
        common = counts.keys() & known.keys()
        if common:
            self.terms += [known[t] for t in common]
            self.tf += [counts[t] for t in common]
            self.entries += [len(self.docs)] * len(common)
            self.docs.append(doc_id)
            self.n.append(len(terms))

    def row(self, number: int) -> pa.RecordBatch:
        terms = np.array(self.terms, np.int32)
        order = np.argsort(terms, kind="stable")
        names, starts = np.unique(terms[order], return_index=True)
        parts = (
            np.array(self.n, np.int64), names.astype(np.int32), np.append(starts, len(terms)).astype(np.int64),
            np.array(self.entries, np.int32)[order], np.array(self.tf, np.int64)[order],
        )
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([self.docs], pa.list_(pa.int64())),
             *[pa.array([p.tobytes()], pa.binary()) for p in parts],
             pa.array([self.rows], pa.int64()), pa.array([self.words], pa.int64())],
            names=[c.split()[0] for c in POSTINGS.split(", ")],
        )


def frequencies(blocks: DataFrame) -> dict[int, int]:
    """Documents that hold each item term. As many as the items have terms, which ITEM_BYTES bounds."""

    def run(batches):
        for batch in slices(batches, 1):
            terms, starts = (np.frombuffer(batch.column(i)[0].as_py(), k) for i, k in enumerate((np.int32, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.diff(starts))], names=["term", "df"])

    counted = blocks.select("terms", "starts").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df"))
    return dict(map(tuple, counted.collect()))


def build_index(blocks: DataFrame, items: Items, documents: int, words: int) -> DataFrame:
    """The blocks with impacts for term counts, the largest impact of every term, and of every pair the
    list of documents that hold both and the largest joint impact in it."""
    shared = blocks.sparkSession.sparkContext.broadcast((items.weights, items.pairs))

    def run(batches):
        weights, pairs = shared.value
        for batch in slices(batches, 1):
            n, terms, starts, entries, tf = (
                np.frombuffer(batch.column(i + 1)[0].as_py(), k)
                for i, k in enumerate((np.int64, np.int32, np.int64, np.int32, np.int64))
            )
            m = (75 + (25 * n * documents) // max(words, 1))[entries]
            impacts = np.repeat(weights[terms], np.diff(starts)) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            maxima = np.maximum.reduceat(impacts, starts[:-1]) if len(terms) else impacts
            place = {int(t): i for i, t in enumerate(terms)}
            lists, joint = [], []
            for number, (a, b) in enumerate(pairs):
                if a in place and b in place:
                    (x, y), (u, v) = ((slice(starts[place[t]], starts[place[t] + 1])) for t in (a, b)), (a, b)
                    both, at_x, at_y = np.intersect1d(entries[x], entries[y], assume_unique=True, return_indices=True)
                    if len(both):
                        lists.append(np.concatenate([[number, len(both)], both]).astype(np.int32))
                        joint.append((impacts[x][at_x] + impacts[y][at_y]).max())
            binaries = (
                terms, starts, entries, impacts, maxima,
                np.concatenate(lists) if lists else np.zeros(0, np.int32), np.array(joint, np.int64),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([b.tobytes()], pa.binary()) for b in binaries]],
                names=[c.split()[0] for c in INDEX.split(", ")],
            )

    return blocks.select("docs", "n", "terms", "starts", "entries", "tf").mapInArrow(run, INDEX)


class _Reader:
    """One block of the index, ready for items."""

    def __init__(self, batch: pa.RecordBatch, pairs: list[tuple[int, int]]):
        self.docs = batch.column(0)[0].as_py()
        kinds = (np.int32, np.int64, np.int32, np.int64, np.int64, np.int32, np.int64)
        terms, self.starts, self.entries, self.impacts, self.maxima, lists, joint = (
            np.frombuffer(batch.column(i + 1)[0].as_py(), k) for i, k in enumerate(kinds)
        )
        self.place = {int(t): i for i, t in enumerate(terms)}
        self.both, self.joint, at = {}, {}, 0
        for most in joint.tolist():
            number, size = lists[at : at + 2].tolist()
            self.both[pairs[number]], self.joint[pairs[number]] = lists[at + 2 : at + 2 + size], most
            at += 2 + size

    def largest(self, term: int) -> int:
        return int(self.maxima[self.place[term]]) if term in self.place else 0

    def bound(self, group: tuple[int, ...], counts: dict[int, int]) -> int:
        """The most that the terms of a group can add to one document of the block.

        A document has both terms, and then no more than the joint maximum for each time the
        item has both, or one of them. Never above the sum of the terms' own maxima.
        """
        alone = [counts[t] * self.largest(t) for t in group]
        if len(group) == 1 or group not in self.joint:
            return max(alone)
        fewer = min(counts[t] for t in group)
        together = fewer * self.joint[group] + sum((counts[t] - fewer) * self.largest(t) for t in group)
        return max(*alone, min(together, sum(alone)))

    def add(self, scores: np.ndarray, term: int, times: int, wanted: np.ndarray | None = None) -> np.ndarray:
        """Add a term's impacts to the scores, to those of ``wanted`` documents only; the documents."""
        at = self.place.get(term)
        if at is None:
            return np.zeros(0, np.int32)
        entries = self.entries[self.starts[at] : self.starts[at + 1]]
        impacts = self.impacts[self.starts[at] : self.starts[at + 1]]
        if wanted is not None:
            here = wanted[entries]
            entries, impacts = entries[here], impacts[here]
        scores[entries] += times * impacts
        return entries

    def seed(self, groups: list[tuple[int, ...]], counts: dict[int, int], best: int) -> list[tuple[int, int]]:
        """True scores of the documents in the most promising pair list, the ``best`` highest."""
        kept = [g for g in groups if g in self.both]
        if not kept:
            return []
        first = max(kept, key=lambda g: (self.bound(g, counts), g))
        wanted, scores = np.zeros(len(self.docs), bool), np.zeros(len(self.docs), np.int64)
        wanted[self.both[first]] = True
        for term, times in counts.items():
            self.add(scores, term, times, wanted)
        return heapq.nlargest(best, scores[self.both[first]].tolist())

    def search(self, groups: list[tuple[int, ...]], counts: dict[int, int], floor: int) -> list[tuple[int, int]]:
        """Places and scores of all documents whose score is at least ``floor`` and above 0.

        Groups whose bounds together stay below the floor cannot bring in a document on their
        own: only the other groups' lists are read for candidates, and the rest is looked up
        for them, ever fewer of them, while what is left to add can still lift them.
        """
        bounds = sorted((b, g) for g in groups if (b := self.bound(g, counts)) > 0)
        sums = np.cumsum([b for b, _ in bounds]) if bounds else np.zeros(0, np.int64)
        rest = int(np.searchsorted(sums, floor, "left"))
        if rest == len(bounds):
            return []
        scores, wanted = np.zeros(len(self.docs), np.int64), np.zeros(len(self.docs), bool)
        for _, group in bounds[rest:]:
            for term in group:
                wanted[self.add(scores, term, counts[term])] = True
        for i in range(rest - 1, -1, -1):
            wanted &= scores + int(sums[i]) >= floor
            if not wanted.any():
                return []
            for term in bounds[i][1]:
                self.add(scores, term, counts[term], wanted)
        found = np.flatnonzero(wanted & (scores >= max(floor, 1)))
        return list(zip(found.tolist(), scores[found].tolist(), strict=True))


def _order(score: int, doc_id: int | None) -> tuple:
    """Larger is better: the score, then the smaller doc_id; a null one comes last."""
    return score, doc_id is not None, -(doc_id or 0)


def floors(index: DataFrame, items: Items, best: int) -> dict[int, int]:
    """For every item a score that at least ``best`` documents reach: item number and score."""
    shared = index.sparkSession.sparkContext.broadcast((items.counts, items.groups, items.pairs))

    def run(batches):
        counts, groups, pairs = shared.value
        tops: dict[int, list[int]] = {}
        for batch in slices(batches, 1):
            block = _Reader(batch, pairs)
            for i, (c, g) in enumerate(zip(counts, groups, strict=True)):
                if found := block.seed(g, c, best):
                    tops[i] = heapq.nlargest(best, tops.get(i, []) + found)
        rows = [(i, s) for i, top in tops.items() for s in top]
        yield pa.RecordBatch.from_pylist([{"item": i, "score": s} for i, s in rows], _FLOORS)

    found = index.mapInArrow(run, "item int, score long")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"))))
    return dict(map(tuple, ranked.where(F.col("r") <= best).where(F.col("r") == best).select("item", "score").collect()))


_FLOORS = pa.schema([("item", pa.int32()), ("score", pa.int64())])
_FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def best_documents(index: DataFrame, items: Items, least: dict[int, int], best: int) -> DataFrame:
    """The ``best`` documents of every item in every task: item, doc_id, score."""
    shared = index.sparkSession.sparkContext.broadcast((items.counts, items.groups, items.pairs, least))

    def run(batches) -> Iterator[pa.RecordBatch]:
        counts, groups, pairs, start = shared.value
        tops: dict[int, list[tuple]] = {}
        for batch in slices(batches, 1):
            block = _Reader(batch, pairs)
            for i, (c, g) in enumerate(zip(counts, groups, strict=True)):
                top = tops.setdefault(i, [])
                floor = max(start.get(i, 0), top[0][0] if len(top) == best else 0)
                for at, score in block.search(g, c, floor):
                    entry = _order(score, block.docs[at])
                    if len(top) < best:
                        heapq.heappush(top, entry)
                    else:
                        heapq.heappushpop(top, entry)
        rows = [
            {"item": i, "doc_id": -minus if known else None, "score": score}
            for i, top in tops.items() for score, known, minus in top
        ]
        yield pa.RecordBatch.from_pylist(rows, _FOUND)

    return index.mapInArrow(run, "item int, doc_id long, score long")


def item_blocks(items: DataFrame, most_bytes: int) -> Iterator[list[tuple]]:
    """All items in blocks of bounded bytes, so that what every task holds is bounded whatever their number."""
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    parts = 1 + 2 * total // most_bytes
    for part in range(parts):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()]


def rank_documents(documents: DataFrame, items: DataFrame, best: int = 20, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The ``best`` documents of every item by term weights and saturated counts: item_id, rank, doc_id, score.

    Terms are runs of ASCII letters and digits and of all other characters above ASCII, A-Z
    lower-cased, over whole texts. Scores are integers; equal ones rank by ascending doc_id,
    null last. Only scores above 0 count.

    Null and empty texts have no terms: such documents are never found and such items find
    nothing. Repeated documents rank one by one, repeated items are answered as often as they
    come. Very long texts are one row of one block. Empty tables give an empty result. Columns
    other than doc_id, item_id and text are not read.
    """
    spark, result = documents.sparkSession, None
    for rows in item_blocks(items, item_bytes):
        asked = Items(rows)
        blocks = keep_table(postings(documents, asked), "postings")
        n, words = blocks.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        asked.weigh(n, frequencies(blocks))
        index = keep_table(build_index(blocks, asked, n, words), "index")
        found = best_documents(index, asked, floors(index, asked, best), best)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        names = spark.createDataFrame(list(enumerate(asked.ids)), "item int, item_id long")
        part = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        result = part if result is None else result.union(part)
    return result
