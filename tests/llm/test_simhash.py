import random

import numpy as np
import xxhash
from helpers_llm import awkward, clean_rows, documents, prose

from redpen.llm import simhash
from redpen.llm.components import components


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = lower.translate({c: " " for c in range(9, 14)}).split(" ")
    ws = [w for w in ws if w]
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(names, linked):
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


def test_against_brute_force(spark):
    draw = random.Random(3)
    rows = awkward()
    for i in range(100, 160):
        words = prose(i // 6, 120).split(" ")
        for _ in range(i % 6):
            words[draw.randrange(len(words))] = "other"
        rows.append((i, " ".join(words)))
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {}
    for i, t in rows:
        prints.setdefault(fingerprint(t), []).append(i)
    assert {(r.doc_id, r.fingerprint) for r in got} == {(i, f"{fingerprint(t):016x}") for i, t in rows}
    fps = sorted(prints)
    linked = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]
    root = roots(fps, linked)
    least = {}
    for fp, ids in prints.items():
        known = [i for i in ids if i is not None]
        least[root[fp]] = min([*known, *([least[root[fp]]] if least.get(root[fp]) is not None else [])], default=None)
    for r in got:
        assert r.component_id == least[root[int(r.fingerprint, 16)]]


def test_crowded_buckets_give_the_same_classes(spark):
    draw = random.Random(5)
    center = draw.getrandbits(64)
    fps = {center}
    while len(fps) < 150:
        x = draw.choice(sorted(fps))
        for _ in range(draw.randint(1, 4)):
            x ^= 1 << draw.randrange(40)
        fps.add(x)
    signed = [simhash._signed(f) for f in sorted(fps)]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {r.node: r.root for r in components(edges).collect()}
    masked = {f: f & (1 << 64) - 1 for f in signed}
    linked = [(a, b) for a in signed for b in signed if a < b and (masked[a] ^ masked[b]).bit_count() <= 3]
    want = roots(signed, linked)
    assert {f: got.get(f, f) for f in signed} == want


def test_spanning_links_join_the_same_rows():
    draw = np.random.default_rng(1)
    fps = draw.integers(0, 1 << 12, 200).astype(np.int64)
    fps = np.unique(fps)
    pivots = np.array(simhash.pivots(), np.int64).view(np.uint64)
    table = np.zeros(len(fps), np.int64)
    for i, p in enumerate(pivots):
        table |= np.bitwise_count(fps.view(np.uint64) ^ p).astype(np.int64) << (8 * i)
    names = fps.tolist()
    all_links = [(a, b) for a in names for b in names if a < b and (a ^ b).bit_count() <= 3]
    assert roots(names, simhash.spanning_links(fps, table)) == roots(names, all_links)


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 500), (701, 700)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 700: 700, 701: 700}


def test_stage_keeps_one_of_each_group(spark):
    rows = awkward()
    kept = simhash.drop_near_duplicates(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=repr) == sorted([1, 4, None, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16], key=repr)


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).collect() == []
    assert clean_rows(simhash.drop_near_duplicates(documents(spark, [])).collect()) == []


def shingle_set(text):
    ws = text.split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def left_by_brute_force(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    linked = [
        (a, b) for a in sets for b in sets
        if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    ]
    return set(roots(list(sets), linked).values())


def fresh(tag, n):
    return [f"{tag}x{i}" for i in range(n)]


def test_stage_compares_sets_not_counts(spark):
    line = " ".join(fresh("line", 14))
    rows = [(i, " ".join(fresh(f"d{i}", 104)) + f" {line}" * 20) for i in range(12)]
    repeated = " ".join(fresh("r", 60))
    base = " ".join(fresh("s", 300))
    rows += [(50, f"{base} {repeated}"), (51, base + f" {repeated}" * 40)]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(documents(spark, rows)).collect()}
    assert kept == left_by_brute_force(rows) == {*range(12), 50}


def test_stage_against_brute_force_at_the_limit(spark):
    draw, rows = random.Random(9), []
    for i in range(240):
        words = fresh(f"p{i}", draw.randrange(60, 400))
        n = len(words) - 4
        changed = round((1 - (0.78 + 0.07 * i / 240)) / (1 + 0.78 + 0.07 * i / 240) * n)
        other = words[: len(words) - changed] + fresh(f"q{i}", changed)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    centre = fresh("c", 300)
    for i in range(90):
        rows.append((1000 + i, " ".join(centre[: 300 - i // 2] + fresh(f"e{i}", i // 2))))
    rows += [(2000 + n, " ".join(fresh("t", n))) for n in range(1, 14)]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(documents(spark, rows)).collect()}
    want = left_by_brute_force(rows)
    assert 240 < len(want & set(range(480))) < 480
    assert kept == want
