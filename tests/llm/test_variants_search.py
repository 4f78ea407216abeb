"""Spelling variants, chosen-path classes and ranked search against brute-force readings of their contracts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

from helpers_llm import awkward, clean_rows, documents, prose

from redpen.llm import chosen_path, ranking, spelling

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def variants(rows, shortest=7):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) - len(short) == 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


def misspelt_prose(seed, n):
    draw = random.Random(seed)
    stems = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(6, 12))) for _ in range(20)]
    weights = [1 + 40 * (k % 5 == 0) for k in range(len(stems))]
    out = []
    for _ in range(n):
        word = draw.choices(stems, weights)[0]
        if draw.random() < 0.15:
            at, kind = draw.randrange(len(word)), draw.randrange(3)
            word = word[:at] + draw.choice(["", "a", "e"]) + word[at + (kind > 0) :]
        out.append(word.upper() if draw.random() < 0.1 else word)
    return " ".join(out)


def test_spelling_variants(spark):
    rows = awkward() + [(100 + i, misspelt_prose(i % 7, 300)) for i in range(12)]
    rows += [(200, "z" * 3000 + " " + "z" * 3001 + " " + "y" * 50), (201, "z" * 3000 + " " + "z" * 3001), (202, "z" * 3001)]
    rows += [(300, "A×÷ÀÞß-naïveté's naïveté naïvete naïveté")]
    got = clean_rows(spelling.spelling_variants(documents(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect())
    want = variants(rows)
    assert got == want
    assert sum(r[1] is not None for r in want) > 20


def test_spelling_variants_follow_chains_of_forms(spark):
    rows = [(-1, "abcdefg " * 3000 + "abcdefgh " * 200 + "abcdefghi " * 12 + "abcdefghii " * 2)]
    got = {r.word: (r.form, r.root) for r in spelling.spelling_variants(documents(spark, rows), share=1 << 40).collect()}
    assert got["abcdefghi"] == ("abcdefgh", "abcdefg") and got["abcdefgh"] == ("abcdefg", "abcdefg")
    assert got["abcdefg"] == (None, "abcdefg") and got["abcdefghii"] == (None, "abcdefghii")


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    return frozenset([tuple(ws)] if len(ws) == 1 else zip(ws, ws[1:], strict=False))


def set_classes(rows):
    sets = defaultdict(list)
    for i, t in rows:
        sets[shingles(t)].append(i)
    empty = sets.pop(frozenset(), [])
    names = list(sets)
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            common = len(names[a] & names[b])
            if 100 * common >= 80 * (len(names[a]) + len(names[b]) - common):
                root[find(a)] = find(b)
    classes = defaultdict(list)
    for k, s in enumerate(names):
        classes[find(k)] += sets[s]
    least = {k: min((i for i in ids if i is not None), default=None) for k, ids in classes.items()}
    out = [(i, len(s), least[find(k)], i == least[find(k)]) for k, s in enumerate(names) for i in sets[s]]
    return sorted([*out, *[(i, 0, i, True) for i in empty]], key=repr)


def changed(text, draw, times):
    words = text.split(" ")
    for _ in range(times):
        words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
    return " ".join(words)


def near_rows():
    draw = random.Random(11)
    rows = awkward() + [(20, "ONE"), (21, "one one"), (22, "one one one")]
    for i in range(120):  # similarities on both sides of the limit
        rows.append((1000 + i, changed(prose(50 + i // 6, 150), draw, i % 6 * 3)))
    return rows


def test_chosen_path_classes(spark):
    rows = near_rows()
    got = clean_rows(chosen_path.near_duplicates(documents(spark, rows)).collect())
    assert got == set_classes(rows)


def test_chosen_path_large_and_dense_nodes(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "FEW", 4)
    monkeypatch.setattr(chosen_path, "CHUNK", 16)
    monkeypatch.setattr(chosen_path, "CHUNK_BYTES", 20_000)
    draw = random.Random(4)
    base = prose(77, 160)
    rows = near_rows() + [(5000 + i, changed(base, draw, draw.randrange(14))) for i in range(90)]
    line = "the same line stands in all of these texts " * 3
    rows += [(6000 + i, line + prose(300 + i, 60)) for i in range(60)]
    got = clean_rows(chosen_path.near_duplicates(documents(spark, rows)).collect())
    assert got == set_classes(rows)


def test_trees_and_sketches_meet_the_recall():
    assert chosen_path.trees_for(0.99999, 0.8) == 8
    p = 0.8 + 0.2 / 256
    least = chosen_path.fewest_equal(0.8)
    missed = sum(math.comb(128, n) * p**n * (1 - p) ** (128 - n) for n in range(least))
    assert missed <= chosen_path.MISSED and least > 70


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(ASCII_LOWER))


def ranked(rows, items, best):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n_docs, words = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * n_docs // words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t in terms(text) if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item_id, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:best])]
    return sorted(out, key=repr)


def test_ranked_search(spark, monkeypatch):
    rows = awkward() + [(400 + i, prose(i % 30, 40 + 7 * i)) for i in range(80)]
    items = [(i, prose(i, 25)) for i in range(12)] + [
        (50, None), (51, ""), (52, "no-such-term!"), (53, "one"), (54, "Ünïcode 😀 ÜNÏCODE"), (3, prose(3, 8) * 4), (None, "two words"),
    ]
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, rank string, score int")
    want = ranked(rows, items, 5)
    for few in (4096, 7):  # one block, and so many that whole blocks are skipped
        monkeypatch.setattr(ranking, "BLOCK_ROWS", few)
        got = clean_rows(ranking.rank_documents(documents(spark, rows), asked, best=5).collect())
        assert got == want
    got = clean_rows(ranking.rank_documents(documents(spark, rows), asked, best=5, item_bytes=2500).collect())
    assert got == want  # several passes


def test_pair_bounds_are_never_below_a_score(spark):
    rows = [(i, prose(i % 9, 60)) for i in range(40)]
    asked = ranking.Items([(i, prose(i, 30)) for i in range(9)])
    blocks = ranking.postings(documents(spark, rows), asked).cache()
    asked.weigh(40, ranking.frequencies(blocks))
    index = ranking.build_index(blocks, asked, 40, blocks.agg({"words": "sum"}).first()[0])
    tighter = 0
    for batch in index.toArrow().to_batches(max_chunksize=1):
        block = ranking._Reader(batch, asked.pairs)
        for counts, groups in zip(asked.counts, asked.groups, strict=True):
            for group in groups:
                scores = [0] * len(block.docs)
                for t in group:
                    at = block.place.get(t)
                    for k in range(*(block.starts[at : at + 2] if at is not None else (0, 0))):
                        scores[block.entries[k]] += counts[t] * int(block.impacts[k])
                bound, alone = block.bound(group, counts), sum(counts[t] * block.largest(t) for t in group)
                assert max(scores, default=0) <= bound <= alone
                tighter += bound < alone
    assert tighter > 0


def test_empty_tables(spark):
    none = documents(spark, [])
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert spelling.spelling_variants(none).collect() == []
    assert chosen_path.near_duplicates(none).collect() == []
    assert ranking.rank_documents(none, items).collect() == []
    assert ranking.rank_documents(documents(spark), items.limit(0)).collect() == []
