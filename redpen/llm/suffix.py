"""Long repeated byte strings by run-compressed backward search over shared contexts.

A Burrows-Wheeler transform of a whole corpus cannot be cut into independent tasks, so the
corpus is first dealt out: every 400-byte string holds one anchor that its bytes alone
determine, and equal strings meet under the hash of their anchor. The suffix range of an anchor
is sorted, and the transform's column of preceding bytes is read one step to the left at a
time. Only where a run of that column ends does the range split; within a run nothing has
to be done. The neighbours in the sorted range give the matching statistics at each step.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpen.llm.common import keep_table

LENGTH = 400
ANCHOR = 64  # bytes of an anchor, a power of two
WINDOWS = LENGTH - ANCHOR + 1  # anchors that a string of LENGTH bytes contains
PAD = 0xFF  # never a byte of UTF-8
BLOCK = 1 << 16  # windows searched at a time
BATCH_ROWS = 20_000  # contexts compared at a time
MOST_ROWS = 50_000  # distinct contexts of one anchor; beyond it windows are compared by digests
BYTES = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ANCHOR bytes from every place on, by doubling."""
    h, size = BYTES[data], 1
    while size < ANCHOR:
        h = h[:-size] * ODD + (h[size:] ^ (h[size:] >> np.uint64(29)))
        size *= 2
    h ^= h >> np.uint64(32)
    return h * ODD


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors: for every LENGTH bytes the first anchor of the least hash."""
    octets = np.frombuffer(data, np.uint8)
    places, hashes = [], []
    for at in range(0, len(octets) - LENGTH + 1, BLOCK):
        h = _anchor_hashes(octets[at : at + BLOCK + LENGTH - 1])
        least = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= WINDOWS:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        rest = WINDOWS - size
        least = np.minimum(least[: len(least) - rest], least[rest:])
        found = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        found = found[np.concatenate([[True], found[1:] != found[:-1]])]
        places.append(found + at)
        hashes.append(h[found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, value = np.concatenate(places), np.concatenate(hashes)
    first = np.concatenate([[True], place[1:] != place[:-1]])  # a block may end inside an anchor's range
    return place[first], value[first]


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, key of the text, its size and digest, and its anchors (hash, place)."""

    def run(batches):
        for batch in batches:
            offsets, places, hashes = [0], [], []
            for text in batch.column(4):
                place, value = anchors(text.as_buffer() or b"")
                places.append(place)
                hashes.append(value.view(np.int64))
                offsets.append(offsets[-1] + len(place))
            flat = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(hashes) if hashes else [], pa.int64()),
                 pa.array(np.concatenate(places) if places else [], pa.int64())], names=["hash", "at"]
            )
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(4)], lists], names=["doc_id", "k", "n_bytes", "whole", "anchors"]
            )

    return _keyed(documents).mapInArrow(
        run, "doc_id long, k binary, n_bytes long, whole string, anchors array<struct<hash: long, at: long>>"
    )


def _keyed(documents: DataFrame) -> DataFrame:
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data")).select(
        "doc_id", F.unhex(F.md5("data")).alias("k"), F.octet_length("data").cast("long").alias("n_bytes"),
        F.sha2("data", 256).alias("whole"), "data",
    )


def _around(data: bytes, at: int) -> tuple[bytes, bytes]:
    return data[max(0, at + ANCHOR - LENGTH) : at], data[at : at + LENGTH]


def owners(affected: DataFrame) -> DataFrame:
    """hash, context, k, places, n_before, n_after: where the bytes around repeated anchors occur.

    ``context`` is a digest of those bytes. Equal contexts of one text are one row.
    """
    kinds = {"hash": pa.int64(), "context": pa.binary(), "k": pa.binary(), "places": pa.list_(pa.int64()),
             "n_before": pa.int32(), "n_after": pa.int32()}

    def run(batches):
        for batch in batches:
            for k, data, found in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                data, rows = data.as_py(), {}
                for a in found.as_py():
                    before, after = _around(data, a["at"])
                    context = xxhash.xxh3_128_digest(b"%d:%b%b" % (len(before), before, after))
                    rows.setdefault((a["hash"], context, len(before), len(after)), []).append(a["at"])
                yield _batch([(h, c, k.as_py(), p, x, y) for (h, c, x, y), p in rows.items()], kinds)

    return affected.select("k", "data", "anchors").mapInArrow(
        run, "hash long, context binary, k binary, places array<long>, n_before int, n_after int"
    )


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds)
    )


CONTEXTS = "hash long, context binary, before binary, after binary, many boolean, crowded boolean"


def contexts(chosen: DataFrame) -> DataFrame:
    """The bytes of every distinct context, from one text that has it.

    ``chosen`` has data and wanted (at, hash, context, many, crowded).
    """
    kinds = {"hash": pa.int64(), "context": pa.binary(), "before": pa.binary(), "after": pa.binary(),
             "many": pa.bool_(), "crowded": pa.bool_()}

    def run(batches):
        for batch in batches:
            for data, wanted in zip(batch.column(0), batch.column(1), strict=True):
                data = data.as_py()
                yield _batch(
                    [(w["hash"], w["context"], *_around(data, w["at"]), w["many"], w["crowded"]) for w in wanted.as_py()],
                    kinds,
                )

    return chosen.select("data", "wanted").mapInArrow(run, CONTEXTS)


def _matrix(parts: list[bytes], width: int, backwards: bool) -> np.ndarray:
    padded = [p[::-1].ljust(width, b"\xff") for p in parts] if backwards else [p.ljust(width, b"\xff") for p in parts]
    return np.frombuffer(b"".join(padded), np.uint8).reshape(len(parts), width)


def _common(after: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows a and b."""
    if not len(a):
        return np.zeros(0, np.int32)
    differ = after[a] != after[b]
    return np.where(differ.any(1), differ.argmax(1), LENGTH).astype(np.int32)


def repeated_windows(group: np.ndarray, before: list[bytes], after: list[bytes]) -> np.ndarray:
    """For every context and shift: does the string that starts ``shift`` bytes before the anchor occur in another row?

    ``group`` numbers the anchors; rows of different groups never match. Suffixes from the anchor
    on are sorted once. At every step to the left the range of a group splits where runs of the
    preceding byte end; only rows with a new neighbour are compared again, the others keep
    the length of their match.
    """
    n, reach = len(group), LENGTH - ANCHOR
    left, right = _matrix(before, reach, True), _matrix(after, LENGTH, False)
    n_right = np.array([len(a) for a in after], np.int32)
    marks = np.zeros((n, reach + 1), bool)
    lead = group.astype(">u4").view(np.uint8).reshape(n, 4)
    joined = np.ascontiguousarray(np.concatenate([lead, right, np.full((n, 1), 1, np.uint8)], 1))
    order = np.argsort(joined.view(f"S{joined.shape[1]}").ravel(), kind="stable")
    kind = group[order].astype(np.int64)
    # match[i]: common length with the row before in the order, -1 where a class begins.
    match = np.full(n, -1, np.int32)
    same = np.flatnonzero(kind[1:] == kind[:-1]) + 1
    match[same] = _common(right, order[same - 1], order[same])
    for shift in range(reach + 1):
        beside = np.concatenate([match[1:], [-1]])
        alone = (match < 0) & (beside < 0)
        if alone.any():
            keep = ~alone
            order, kind, match, beside = order[keep], kind[keep], match[keep], beside[keep]
        if not len(order):
            break
        longest = np.minimum(np.maximum(match, beside), n_right[order])
        marks[order, shift] = longest >= LENGTH - shift
        if shift == reach:
            break
        ahead = left[order, shift]
        begins = match < 0
        ends = ~begins
        ends[0] = False
        broken = np.flatnonzero(ends[1:] & (ahead[1:] != ahead[:-1])) + 1
        outside = ahead == PAD
        if not len(broken) and not outside.any():
            continue  # every range is one run
        fine = kind * 256 + ahead
        turn = np.argsort(fine, kind="stable")
        turn = turn[~outside[turn]]
        fine, old = fine[turn], order[turn]
        new = np.full(len(turn), -1, np.int32)
        follows = np.flatnonzero(fine[1:] == fine[:-1]) + 1
        kept = turn[follows] == turn[follows - 1] + 1  # still next to the same row
        new[follows[kept]] = match[turn[follows[kept]]]
        moved = follows[~kept]
        new[moved] = _common(right, old[moved - 1], old[moved])
        order, match = old, new
        kind = np.cumsum(np.concatenate([[0], fine[1:] != fine[:-1]])) if len(fine) else fine
    return marks


def shift_runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, first and last shift of the runs of marked windows."""
    edges = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, low = np.nonzero(edges == 1)
    return rows, low, np.nonzero(edges == -1)[1] - 1


RUNS = "hash long, context binary, low int, high int"


def compare(rows: DataFrame) -> DataFrame:
    """Runs of repeated windows of the distinct contexts, all contexts of an anchor in one task.

    Contexts that occur at many places are partners only: all their windows repeat anyway.
    """

    def settle(columns):
        hashes, names, before, after, many = columns
        group = np.unique(np.array(hashes), return_inverse=True)[1]
        marks = repeated_windows(group, before, after)
        marks[np.array(many)] = False
        row, low, high = shift_runs(marks)
        return pa.RecordBatch.from_arrays(
            [pa.array([hashes[r] for r in row], pa.int64()), pa.array([names[r] for r in row], pa.binary()),
             pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=["hash", "context", "low", "high"]
        )

    def run(batches):
        held = [[] for _ in range(5)]
        for batch in batches:
            for mine, column in zip(held, batch.columns, strict=True):
                mine.extend(column.to_pylist())
            if len(held[0]) >= BATCH_ROWS and held[0][0] != held[0][-1]:
                cut = len(held[0]) - 1  # the last anchor may go on in the next batch
                while held[0][cut - 1] == held[0][-1]:
                    cut -= 1
                yield settle([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held[0]:
            yield settle(held)

    return rows.select("hash", "context", "before", "after", "many").mapInArrow(run, RUNS)


def compare_crowded(rows: DataFrame) -> DataFrame:
    """The same for anchors with more contexts than a task should hold: windows meet by a 128-bit digest."""

    def run(batches):
        for batch in batches:
            for h, name, before, after, many in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                shifts = range(max(0, LENGTH - len(after)), len(before) + 1)
                both = before + after
                own = [xxhash.xxh3_128_digest(both[len(before) - s :][:LENGTH]) for s in shifts]
                yield _batch(
                    [(d, h, name, s, many) for d, s in zip(own, shifts, strict=True)],
                    {"digest": pa.binary(), "hash": pa.int64(), "context": pa.binary(), "shift": pa.int32(), "many": pa.bool_()},
                )

    windows = rows.select("hash", "context", "before", "after", "many").mapInArrow(
        run, "digest binary, hash long, context binary, shift int, many boolean"
    )
    # Equal strings hold their anchor at the same shift; a string seen from two anchors is not repeated by that.
    key = ["hash", "shift", "digest"]
    repeated = windows.groupBy(*key).agg(F.min("context").alias("a"), F.max("context").alias("b")).where("a != b").select(*key)
    return windows.where("NOT many").join(repeated, key, "left_semi").select(
        "hash", "context", F.col("shift").alias("low"), F.col("shift").alias("high")
    )


def repeated_ranges(affected: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """Byte ranges k, start, stop that repeated strings cover, from k, data and anchors (at, hash).

    A context that occurs at several places is repeated as it is. Of every distinct context one
    copy is compared with the others of its anchor.
    """
    known = keep_table(owners(affected), "owners")
    shared = known.groupBy("hash", "context", "n_before", "n_after").agg(
        F.min(F.struct("k", F.get("places", 0).alias("at"))).alias("rep"), (F.sum(F.size("places")) > 1).alias("many")
    )
    sizes = shared.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    wanted = shared.join(sizes, "hash").select(
        F.col("rep.k").alias("k"),
        F.struct(F.col("rep.at").alias("at"), "hash", "context", "many", (F.col("n") > most_rows).alias("crowded")).alias("w"),
    ).groupBy("k").agg(F.collect_list("w").alias("wanted"))
    chosen = contexts(affected.select("k", "data").join(wanted, "k"))
    together = chosen.where("NOT crowded").repartition("hash").sortWithinPartitions("hash")
    whole = shared.where("many").select(
        "hash", "context", F.greatest(F.lit(0), LENGTH - F.col("n_after")).alias("low"), F.col("n_before").alias("high")
    ).where("low <= high")
    runs = whole.union(compare(together)).union(compare_crowded(chosen.where("crowded")))
    at = F.explode("places").alias("at")
    return known.select("hash", "context", "k", "places").join(runs, ["hash", "context"]).select("k", at, "low", "high").select(
        "k", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + LENGTH).alias("stop")
    )


def cut_texts(texts: DataFrame) -> DataFrame:
    """k, n_removed, n_spans, kept from k, data and ranges (start, stop)."""

    def run(batches):
        for batch in batches:
            out = []
            for k, data, ranges in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                data, runs = data.as_py(), []
                for r in sorted((r["start"], r["stop"]) for r in ranges.as_py()):
                    if runs and r[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], r[1])
                    else:
                        runs.append(list(r))
                edges = [0, *[x for r in runs for x in r], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((k.as_py(), len(data) - len(kept), len(runs), kept))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["k", "n_removed", "n_spans", "kept"]
            )

    return texts.select("k", "data", "ranges").mapInArrow(run, "k binary, n_removed long, n_spans long, kept binary")


def remove_repeats(documents: DataFrame) -> DataFrame:
    """Every document without the bytes of 400-byte strings that occur elsewhere.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256. A byte goes if any 400-byte
    string over it also starts at another place, in the same text or another; places are
    judged on the input. Texts are UTF-8 bytes and matches never cross them.

    Null and empty texts have no bytes. Texts that occur more than once, repeated rows
    included, go wholly if they have 400 bytes. A null doc_id is kept; an empty table gives
    an empty result. Columns other than doc_id and text are not read.
    """
    scanned = keep_table(scan(documents), "scanned")
    texts = keep_table(
        scanned.groupBy("k").agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("anchors").alias("anchors")
        ), "texts",
    )
    each = texts.select("k", "rep", F.inline("anchors"))
    repeated = each.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    listed = each.join(repeated, "hash", "left_semi").groupBy("k", "rep").agg(
        F.collect_list(F.struct("at", "hash")).alias("anchors")
    )
    whole = _keyed(documents).select("doc_id", "k", "data")
    affected = whole.join(listed, "k").where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("k", "data", "anchors")
    affected = keep_table(affected.dropDuplicates(["k"]), "affected")
    per_text = repeated_ranges(affected).groupBy("k").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    cut = cut_texts(affected.select("k", "data").join(per_text, "k")).select(
        "k", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept")
    )
    known = scanned.select("doc_id", "k", "n_bytes", "whole").join(texts.select("k", "copies"), "k").join(cut, "k", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return known.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
    )
