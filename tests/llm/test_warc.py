import base64
import glob
import gzip
import hashlib
import random

import pytest
from helpers_llm import clean_rows

from redpen.llm import warc


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, sha1 string, size int")


def brute_force(rows, least=0):
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    kept = {}
    for i, p in payloads:
        if i is not None:
            kept[p] = max(i, kept.get(p, i))
    out = []
    for i, p in payloads:
        revisit = kept.get(p) is not None and i != kept[p] and len(p) >= least
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response",
                    kept[p] if revisit else None, True))
    return clean_rows(out)


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip(spark, tmp_path, least):
    draw = random.Random(1)
    long = "".join(draw.choice("abc é😀\r\n<>") for _ in range(120_000))
    rows = [
        (1, "http://a/", "x"), (2, "http://b/ü \r\n", "x"), (3, None, "x"), (4, "http://c/", None), (5, "", ""),
        (6, "http://d/", long), (7, "http://e/", long), (8, "http://f/", "WARC/1.1\r\n\r\n\r\n\r\n0\r\n\r\n"), (9, "u", "same " * 9),
        (9, "u", "same " * 9), (10, "u", "twice " * 9), (11, "u", "twice " * 9), (11, "u", "twice " * 9), (None, "n", "null id here " * 3),
        (None, "n", "x"), (12, "v", "y" * 16_384), (13, "v", "z" * 16_200),
    ]
    path = str(tmp_path / "archives")
    got = warc.round_trip(table(spark, rows), path, least).collect()
    assert clean_rows(got) == brute_force(rows, least)
    records = [r for f in glob.glob(path + "/part-*") for r in warc.parse_records(gzip.open(f).read())]
    kinds = [f["warc-type"] for f, _ in records]
    assert kinds.count("continuation") >= 7 and kinds.count("response") + kinds.count("revisit") == len(rows)
    assert max(len(b) for _, b in records) <= 16_384


def test_missing_and_wrong_segments(spark, tmp_path):
    records = warc.page_records(1, "u", b"a" * 50, None, "d", 40, 7)
    whole = warc.page_records(2, "u", b"b" * 50, None, "d", 40, 7)
    longer = [r.replace(b"Total-Length: ", b"Total-Length: 9") for r in warc.page_records(3, "u", b"c" * 50, None, "d", 40, 7)]
    body = b"".join(r + b"\r\n\r\n" for r in [*records[:2], *records[3:], *reversed(whole), *longer])
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(body))
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert [got[i].complete for i in (1, 2, 3)] == [False, True, False]
    assert got[2].payload_bytes == 50


def test_chunk_framing():
    for payload in (b"", b"a", b"\r\n0\r\n\r\n", bytes(range(256)) * 5):
        assert warc.unframe_chunks(warc.frame_chunks(payload, 7)) == payload
    for broken in (b"", b"5\r\nabc", b"zz\r\n", b"1\r\nab\r\n0\r\n\r\n", b"3\r\nabc\r\n"):
        assert warc.unframe_chunks(broken) is None


def test_no_pages(spark, tmp_path):
    assert warc.round_trip(table(spark, []), str(tmp_path / "none")).collect() == []
