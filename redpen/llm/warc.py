"""WARC archives: segmented, chunk-framed records, and their reassembly."""

import base64
import gzip
import hashlib
import re
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redpen.llm.common import keep_table

CRLF = b"\r\n"
HTTP_HEAD = (
    b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
)
PAGE_URN = re.compile(r"<urn:page:(-?\d*)")


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def frame_chunks(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join([b"%x\r\n%b\r\n" % (len(p), p) for p in parts] + [b"0\r\n\r\n"])


def unframe_chunks(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken or does not end."""
    at, parts = 0, []
    while True:
        end = body.find(CRLF, at)
        head = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", head):
            return None
        size = int(head, 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != CRLF:
            return None
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes | None:
    """The payload of a captured HTTP response, unframed if it is chunked."""
    head, gap, body = block.partition(CRLF + CRLF)
    if not gap:
        return None
    chunked = re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head)
    return unframe_chunks(body) if chunked else body


def _record(fields: dict[str, object], block: bytes) -> bytes:
    """A record without the blank lines after it; fields that are None are left out."""
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    return head.encode() + CRLF + CRLF + block


def page_records(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str,
    segment_bytes: int, chunk_bytes: int,
) -> list[bytes]:
    """The records of a page: a revisit, or a response with as many continuations as its block needs."""
    urn = f"<urn:page:{'' if page_id is None else page_id}:{uuid.uuid4()}>"
    common = {
        "WARC-Record-ID": urn, "WARC-Date": date,
        "WARC-Target-URI": None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%-._~"),
    }
    digest = {"WARC-Payload-Digest": f"sha1:{payload_digest(payload)}"}
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields = {"WARC-Type": "revisit", **common, **digest, "WARC-Profile": profile,
                  "WARC-Refers-To": f"<urn:page:{refers_to}>"}
        return [_record(fields, HTTP_HEAD)]
    block = HTTP_HEAD + frame_chunks(payload, chunk_bytes)
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = []
    for number, piece in enumerate(pieces, 1):
        kind = {"WARC-Type": "response"} if number == 1 else {"WARC-Type": "continuation"}
        own = {**common, "WARC-Record-ID": urn if number == 1 else f"<urn:uuid:{uuid.uuid4()}>"}
        segment = {"WARC-Segment-Number": number} if len(pieces) > 1 else {}
        if number > 1:
            segment["WARC-Segment-Origin-ID"] = urn
        if number == len(pieces) > 1:
            segment["WARC-Segment-Total-Length"] = len(block)
        out.append(_record({**kind, **own, **(digest if number == 1 else {}), **segment}, piece))
    return out


def write_archives(
    pages: DataFrame, path: str, least_bytes: int = 0, segment_bytes: int = 16_384, chunk_bytes: int = 4_096,
    records_per_file: int = 1_000, date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write one response or revisit per row of ``pages`` (page_id, url, html) as WARC files.

    Among rows with equal payloads of at least ``least_bytes``, those with the largest page_id
    are responses and the others revisit it. Archives end at ``records_per_file`` records, so
    no file exceeds that number of segments. Archives are compressed as a whole.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"),
        F.sha1(payload).alias("sha1"), F.length(payload).alias("size"),
    )
    copies = rows.groupBy("sha1", "size").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    copies = copies.where((F.col("n") > 1) & (F.col("size") >= least_bytes)).drop("n")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    marked = rows.join(copies, ["sha1", "size"], "left").select("page_id", "url", "payload", refers.alias("refers_to"))

    def run(batches):
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                records = page_records(*row, date, segment_bytes, chunk_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    # Every line of the text sink is a record, and the blank lines between records end the line.
    records = marked.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    writer = records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file)
    writer.option("compression", "gzip").text(path)


def parse_records(content: bytes):
    """Header fields (lower-case names) and block of every record, by the lengths the headers give."""
    at = 0
    while at < len(content):
        end = content.find(CRLF + CRLF, at)
        if end < 0:
            raise ValueError("record without an end of its header")
        lines = content[at:end].decode().split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        start = end + 4
        stop = start + int(fields["content-length"])
        if not lines[0].startswith("WARC/") or content[stop : stop + 4] != CRLF + CRLF:
            raise ValueError("broken record")
        yield fields, content[start:stop]
        at = stop + 4


def _page_of(urn: str | None) -> int | None:
    found = PAGE_URN.match(urn or "")
    return int(found[1]) if found and found[1] else None


RECORDS = (
    "kind string, page_id long, refers_to long, digest string, size long, complete boolean, "
    "origin string, number int, total long, block binary"
)


def _told(page_id, block: bytes, total: int | None):
    """Row of a whole response block."""
    payload = http_payload(block)
    complete = payload is not None and (total is None or total == len(block))
    body = payload or b""
    return ("response", page_id, None, payload_digest(body), len(body), complete, None, None, None, None)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Captures in the archives of a folder: page_id, payload_bytes, payload_digest, record_type, refers_to, complete.

    Files are gzip members. Whole responses are decoded where they are read. Segments are grouped by the id of their
    first record, ordered by number, checked against the total length, and decoded after
    that. Revisits take the size of the response they refer to. ``complete`` is false for a
    capture with missing segments, a wrong total length or broken chunk framing.
    """

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse_records(gzip.decompress(content.as_py())):
                    kind, own = fields["warc-type"], fields["warc-record-id"]
                    number = int(fields.get("warc-segment-number", 0))
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    if kind == "revisit":
                        refers = _page_of(fields.get("warc-refers-to"))
                        rows.append(("revisit", _page_of(own), refers, digest, None, True, None, None, None, None))
                    elif number:
                        origin = fields.get("warc-segment-origin-id", own)
                        total = fields.get("warc-segment-total-length")
                        rows.append(("segment", _page_of(origin), None, None, None, None, origin, number,
                                     None if total is None else int(total), block))
                    elif kind == "response":
                        rows.append(_told(_page_of(own), block, None))
                yield _batch(rows)

    def join(batches):
        for batch in batches:
            for page_id, parts, total in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                whole = [p["number"] for p in parts] == list(range(1, len(parts) + 1)) and total is not None
                block = b"".join(p["block"] for p in parts)
                yield _batch([_told(page_id, block, total if whole else -1)])

    files = spark.read.format("binaryFile").load(path).select("content")
    found = keep_table(files.mapInArrow(read, RECORDS), "records")
    parts = F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts")
    split = found.where("kind = 'segment'").groupBy("origin").agg(
        F.first("page_id").alias("page_id"), parts, F.max("total").alias("total")
    )
    joined = split.select("page_id", "parts", "total").mapInArrow(join, RECORDS)
    responses = keep_table(
        found.where("kind = 'response'").union(joined).select("page_id", "size", "digest", "complete"), "responses"
    )
    known = responses.groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.max("size").alias("size"))
    revisits = found.where("kind = 'revisit'").select("page_id", "refers_to", "digest").join(
        known, ["refers_to", "digest"], "left"
    )
    return responses.select(
        "page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "complete",
    ).union(
        revisits.select(
            "page_id", "size", "digest", F.lit("revisit"), "refers_to", F.col("size").isNotNull()
        )
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {
        "kind": pa.string(), "page_id": pa.int64(), "refers_to": pa.int64(), "digest": pa.string(), "size": pa.int64(),
        "complete": pa.bool_(), "origin": pa.string(), "number": pa.int32(), "total": pa.int64(), "block": pa.binary(),
    }
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds)
    )


def round_trip(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives under ``path`` and read the captures back.

    One capture per row. A null html is an empty payload, a null url has no target header, a
    null page_id stays null and is never referred to unless no other is there (then all such
    rows are responses). Repeated rows with the largest page_id are all responses. An empty
    table gives an empty result. Other columns are not read.
    """
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path)
