import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers_llm import awkward, clean_rows, documents, prose

from redpen.llm import suffix


def brute_force(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(t[a : a + 400] for _, t in texts for a in range(len(t) - 399))
    out = []
    for i, t in texts:
        covered = bytearray(len(t))
        for a in range(len(t) - 399):
            if counts[t[a : a + 400]] > 1:
                covered[a : a + 400] = b"\1" * 400
        kept = bytes(b for b, c in zip(t, covered) if not c)
        spans = sum(c and (a == 0 or not covered[a - 1]) for a, c in enumerate(covered))
        out.append((i, len(t), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return clean_rows(out)


def passages():
    draw = random.Random(2)
    shared = [prose(50 + i, 200) for i in range(4)]
    rows = []
    for i in range(40):
        parts = [prose(100 + i, draw.randint(1, 60))]
        for p in draw.sample(shared, draw.randint(0, 3)):
            a = draw.randrange(0, 300)
            parts += [p[a : a + draw.randint(300, 900)], prose(200 + i, draw.randint(1, 40))]
        rows.append((1000 + i, "".join(parts)))
    return rows


def test_against_brute_force(spark):
    rows = awkward() + passages()
    got = suffix.remove_repeats(documents(spark, rows)).collect()
    assert clean_rows(got) == brute_force(rows)


def test_crowded_anchors_give_the_same(spark):
    rows = [r for r in awkward() if r[0] in (1, 3, 13, 14)] + passages()[:20] + [(9, "ab " * 160)]
    marked = _marked(spark, rows)
    together, crowded = suffix.repeated_ranges(marked), suffix.repeated_ranges(marked, most_rows=1)
    assert covered_bytes(crowded) == covered_bytes(together)


def _marked(spark, rows):
    texts = {hashlib.md5(t.encode()).digest(): t.encode() for _, t in rows if t}
    places = {k: suffix.anchors(t) for k, t in texts.items()}
    counts = Counter(h for _, hashes in places.values() for h in hashes.view(np.int64).tolist())
    data = [
        (k, texts[k], [(int(a), h) for a, h in zip(at, hashes.view(np.int64).tolist()) if counts[h] > 1])
        for k, (at, hashes) in places.items()
    ]
    return spark.createDataFrame(
        [(bytearray(k), bytearray(t), a) for k, t, a in data if a],
        "k binary, data binary, anchors array<struct<at: long, hash: long>>",
    )


def covered_bytes(ranges):
    out = {}
    for r in ranges.distinct().collect():
        out.setdefault(bytes(r.k), bytearray(6000))[r.start : r.stop] = b"\1" * (r.stop - r.start)
    return out


@pytest.mark.parametrize("size", [0, 399, 400, 401, 5000, 140_000])
def test_every_string_has_an_anchor_that_only_its_bytes_decide(size):
    data = prose(7, size // 3 + 1).encode()[:size]
    places, hashes = suffix.anchors(data)
    held = dict(zip(places.tolist(), hashes.tolist()))
    for start in range(0, len(data) - 399, 97):
        inside, own = suffix.anchors(data[start : start + 400])
        assert len(inside) == 1 and held[start + int(inside[0])] == int(own[0])


def test_empty_table(spark):
    assert suffix.remove_repeats(documents(spark, [])).collect() == []
