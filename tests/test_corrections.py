"""Applying matches, agreement, profiles, readings, the breaker, bounded and streamed reuse."""

import datetime
import os
import random
from collections import Counter

from pyspark.sql import functions as F

from redpen.operators import apply, edits, fanout, labels, runs, skew
from redpen.sources import streams
from redpen.streaming import jobs

MATCH = "array<struct<offset:int,length:int,replacement:string>>"


def applied(text, matches):
    """Brute force: walk the sorted matches, skip what overlaps."""
    if text is None:
        return None, 0
    end, out, n = 0, "", 0
    order = sorted(
        (m[0], -m[1], i, m[2]) for i, m in enumerate(matches or [])
        if None not in m and m[0] >= 0 and m[1] >= 0 and m[0] + m[1] <= len(text)
    )
    for offset, minus, _, new in order:
        if offset >= end:
            out, end, n = out + text[end:offset] + new, offset - minus, n + 1
    return out + text[end:], n


def test_apply_matches(spark):
    draw = random.Random(1)
    rows = [(0, None, [(0, 1, "x")]), (1, "", [(0, 0, "new")]), (2, "abc", None), (3, "abc", []), (4, "é😀z", [(1, 1, "ü"), (2, 5, "out")])]
    rows += [(5, "abcdef", [(1, 2, "X"), (1, 3, "longer"), (2, 1, "Y"), (4, 0, "+"), (None, 1, "n"), (-1, 1, "n"), (5, 1, None)])]
    for i in range(6, 60):
        text = "".join(draw.choice("abcdé ") for _ in range(draw.choice([5, 40, 400])))
        k = draw.choice([1, 5, 64, 65, 200])
        rows.append((i, text, [(draw.randrange(len(text) + 3), draw.randrange(4), draw.choice(["", "q", "long"])) for _ in range(k)]))
    df = spark.createDataFrame(rows, f"id int, text string, matches {MATCH}")
    got = {r.id: (r.applied, r.n_applied) for r in apply.apply_matches(df).collect()}
    assert got == {i: applied(t, m) for i, t, m in rows}


def test_apply_match_rows_keeps_sentences_without_matches(spark):
    sentences = spark.createDataFrame([(1, 0, "he are"), (1, 1, "fine"), (2, 0, None)], "doc_id int, sent_idx int, text string")
    found = spark.createDataFrame(
        [(1, 0, 3, 3, "is", 1, 0), (1, 0, 3, 3, "were", 0, 0)],
        "doc_id int, sent_idx int, offset int, length int, replacement string, corrector_idx int, match_idx int",
    )
    got = apply.apply_match_rows(sentences, found, ["doc_id", "sent_idx"]).collect()
    assert {(r.doc_id, r.sent_idx): (r.applied, r.n_applied) for r in got} == {
        (1, 0): ("he were", 1), (1, 1): ("fine", 0), (2, 0): (None, 0)}


def test_cut_off_is_the_head_of_the_sorted_table(spark):
    draw = random.Random(2)
    rows = [(draw.choice([-5, 0, 0, 7, 10**15, None]), draw.randrange(-(2**61), 2**61)) for _ in range(500)]
    rows += [(7, 1), (7, 1), (7, 1)]
    df = spark.createDataFrame(rows, "a long, b long").cache()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for n in (0, 1, 3, 120, 250, 251, 400, 503, 600):
        got = sorted(map(tuple, skew.cut_off(df, ["a", "b"], n).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        last = order[min(n, len(order)) - 1] if n else None
        want = [r for r in order if last and (order.index(r) < n or r == last)]
        assert got == want or (last and last[0] is None and got == order)


def _shout(texts):
    return texts.withColumn("corrected", F.upper("text"))


def test_texts_of_any_length_are_joined_by_their_key(spark):
    long, other = "word " * 210_000, "word " * 210_000 + "!"
    rows = [(1, long), (2, other), (3, long), (4, None), (5, ""), (6, None), *[(10 + i, "hot") for i in range(3000)]]
    df = spark.createDataFrame(rows, "id int, text string")
    seen = spark.sparkContext.accumulator(0)

    def compute(texts):
        seen.add(texts.count())
        return texts.withColumn("size", F.length("text"))

    got = fanout.once_per_text(df, compute)
    assert got.columns == ["text", "id", "size"]
    assert {r.id: r.size for r in got.collect()} == {i: None if t is None else len(t) for i, t in rows}
    assert seen.value == 5
    results, cache = fanout.reuse(df, spark.createDataFrame([(long, 7)], "text string, size int"), compute)
    assert {r.id: (r.size, r.hit) for r in results.where("id < 10").collect()} == {
        1: (7, True), 3: (7, True), 2: (len(other), False), 4: (None, False), 5: (0, False), 6: (None, False)}
    assert cache.count() == 5


def test_reuse_bounded_keeps_the_latest(spark):
    cache = _shout(spark.createDataFrame([(f"old {i}", i) for i in range(20)], "text string, used long"))
    asked = spark.createDataFrame([("old 3", 100), ("old 3", 90), ("new", 101), ("newer", 102), (None, 103)], "text string, asked long")
    results, kept = fanout.reuse_bounded(asked.where("text IS NOT NULL"), cache, _shout, 5)
    assert {r.text: (r.corrected, r.hit) for r in results.collect()} == {
        "old 3": ("OLD 3", True), "new": ("NEW", False), "newer": ("NEWER", False)}
    assert {r.text: r.used for r in kept.collect()} == {"newer": 102, "new": 101, "old 3": 100, "old 19": 19, "old 18": 18}


def test_keep_latest_ties_by_digest_and_a_large_capacity(spark):
    cache = spark.createDataFrame([(f"t{i}", 7) for i in range(300)], "text string, used long")
    import hashlib

    want = sorted((f"t{i}" for i in range(300)), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert {r.text for r in fanout.keep_latest(cache, 17).collect()} == set(want[:17])
    assert fanout.keep_latest(cache, 1000).count() == 300
    assert fanout.keep_latest(cache.limit(0), 5).count() == 0


def test_reuse_in_batches_survives_a_batch_run_twice(spark, tmp_path):
    asked, known, out, state = (str(tmp_path / n) for n in ("asked", "known", "out", "state"))
    parts = [[(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (5, "c"), (6, None)], [(7, "c"), (8, "a"), (9, "d")]]
    computed = spark.createDataFrame([], "text string, corrected string").schema
    calls = []

    def compute(texts):
        calls.append(sorted(r.text for r in texts.collect()))
        return _shout(texts)

    def go():
        stream = streams.stream_table(spark, asked, spark.read.parquet(asked).schema, 1)
        jobs.reuse_in_batches(stream, compute, computed, out, known, state)
        return Counter((r.id, r.corrected, r.reused) for r in spark.read.parquet(out).collect())

    for part in parts:
        spark.createDataFrame(part, "id int, text string").coalesce(1).write.mode("append").parquet(asked)
        got = go()
    assert calls == [["a", "b"], ["c"], ["d"]]
    last = max((f for f in os.listdir(f"{state}/commits") if f.isdigit()), key=int)
    for name in (last, f".{last}.crc"):  # as if the job had died before it noted the batch as done
        if os.path.exists(f"{state}/commits/{name}"):
            os.remove(f"{state}/commits/{name}")
    again = go()
    assert calls[3] == ["d"] and again == got
    assert got == Counter([
        (1, "A", False), (2, "B", False), (3, "A", False), (4, "B", True), (5, "C", False), (6, None, None), (7, "C", True),
        (8, "A", True), (9, "D", False)])
    stored = [r.text for r in jobs.known_results(spark, known, computed).collect()]
    assert sorted(stored) == ["a", "b", "c", "d"]


def test_match_rows_merge_in_any_order_and_late_ones_are_counted(spark, tmp_path):
    schema = "sent int, ts timestamp, corrector_idx int, match_idx int, offset int, length int, replacement string"
    day = datetime.datetime(2024, 1, 1)

    def at(minutes):
        return day + datetime.timedelta(minutes=minutes)

    rows = [(s, at(s), c, m, 10 - 3 * m, 2, f"r{m % 2}") for s in range(6) for c in range(3) for m in range(3)]
    random.Random(3).shuffle(rows)
    files = [rows[:20], rows[20:40], rows[40:], [(90, at(500), 0, 0, 1, 1, "x")], [(2, at(2), 0, 9, 0, 1, "late")], [(91, at(1200), 0, 0, 1, 1, "y")]]
    asked = str(tmp_path / "asked")
    for part in files:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(asked)
        stream = streams.stream_table(spark, asked, spark.read.parquet(asked).schema, 1)
        jobs.run_available(jobs.merge_match_stream(stream, ["sent"], "ts", "60 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.sent: [(m.offset, m.corrector_idx, m.match_idx) for m in r.matches] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = [(4, 0, 2), (7, 0, 1), (10, 0, 0)]
    assert {s: got[s] for s in range(6)} == {s: want for s in range(6)}
    merged = spark.read.parquet(str(tmp_path / "out")).where("sent < 90").agg(F.sum("n_rows")).first()[0]
    assert len(rows) + 1 - merged == 1  # one row came too late


def walked(calls, window_s, min_calls, threshold, down_ms):
    per = {}
    for rule, second, ok in calls:
        n, bad = per.get((rule, second), (0, 0))
        per[rule, second] = n + 1, bad + (ok is False)
    state, out = {}, []
    for (rule, second), (n, bad) in sorted(per.items(), key=lambda x: (str(x[0][0]), x[0][1])):
        window, down = state.get(rule, ([], None))
        counted = down is None or second * 1000 >= down
        held = failed = 0
        tripped = False
        if counted:
            down = None
            window = [w for w in window if w[0] > second - window_s] + [(second, n, bad)]
            held, failed = sum(w[1] for w in window), sum(w[2] for w in window)
            tripped = held >= min_calls and failed * 100.0 / held >= threshold
            if tripped:
                window, down = [], second * 1000 + down_ms
        state[rule] = window, down
        out.append((rule, second, n, bad, counted, held, failed, tripped, down))
    return sorted(out, key=repr)


def test_breaker_states(spark):
    draw = random.Random(5)
    calls = []
    for rule, busy in (("hot", 6000), ("calm", 150), (None, 80)):
        second = 1_700_000_000
        for _ in range(busy):
            second += draw.choice([0, 0, 1, 1, 2, 5] + ([90, 200] if rule != "hot" else []))
            calls.append((rule, second, draw.choice([True, True, False, None])))
    rows = [(r, datetime.datetime.fromtimestamp(s, datetime.UTC), ok) for r, s, ok in calls] + [("calm", None, True)]
    df = spark.createDataFrame(rows, "rule_id string, ts timestamp, ok boolean")
    for options in ((60, 10, 30.0, 5000), (7, 3, 40.0, 1), (5, 1, 20.0, 90_500)):
        got = sorted(map(tuple, runs.breaker_states(df, *options).collect()), key=repr)
        assert got == walked(calls, *options)
        assert sum(r[7] for r in got) > 3
    assert runs.breaker_states(df.limit(0)).collect() == []


def test_agreement_matrix(spark):
    draw = random.Random(6)
    rows, item = [], "array<struct<offset:int,length:int,replacement:string,corrector_idx:int>>"
    for i in range(40):
        rows.append((i, [(draw.randrange(3), 1, draw.choice(["a", "b", None]), draw.randrange(3)) for _ in range(draw.randrange(12))]))
    rows.append((99, None))
    df = spark.createDataFrame(rows, f"id int, matches {item}")
    keys = {}
    for i, ms in rows:
        for o, n, r, c in ms or []:
            keys.setdefault((i, o, n, r), set()).add(c)
    for r in runs.corrector_agreement(df, 4).collect():
        n_a, n_b = (sum(c in s for s in keys.values()) for c in (r.a, r.b))
        both = sum(r.a in s and r.b in s for s in keys.values())
        assert (r.both, r.n_a, r.n_b, r.expected) == (both, n_a, n_b, n_a * n_b / len(keys))
        assert r.agreement == (both / (n_a + n_b - both) if n_a + n_b else None)


def test_error_profile_tells_subtotals_from_null_groups(spark):
    df = spark.createDataFrame([("x", "en"), ("x", None), ("y", None), ("y", None)], "label string, lang string")
    got = {(r.label, r.lang, r.total_label, r.total_lang): r.n for r in runs.error_profile(df, ["label", "lang"]).collect()}
    assert got[None, None, True, False] == 3 and got[None, None, True, True] == 4
    assert got["x", None, False, False] == 1 and got["x", None, False, True] == 2
    assert len(got) == 8


READ = "array<struct<pos:string,form:string,lemma:string>>"


def test_pos_codes(spark):
    go, goes, went, going = (("VERB", f, "go") for f in ("VBP", "VBZ", "VBD", "VBG"))
    cat, cats, cat_s, dog = ("NOUN", "NN", "cat"), ("NOUN", "NNS", "cat"), ("NOUN", "POS", "cat"), ("PROPN", "NN", "dog")
    big, bigger, quick, quickly = ("ADJ", "JJ", "big"), ("ADJ", "JJR", "big"), ("ADJ", "JJ", "quick"), ("ADV", "RB", "quick")
    cases = [
        ("R:OTHER", [go], [goes], "R:VERB:SVA"), ("R:OTHER", [go], [went], "R:VERB:TENSE"), ("R:OTHER", [goes], [going], "R:VERB:FORM"),
        ("R:OTHER", [cat], [cats], "R:NOUN:NUM"), ("R:OTHER", [cats], [cat_s], "R:NOUN:POSS"), ("R:OTHER", [cat], [dog], "R:NOUN"),
        ("R:OTHER", [big], [bigger], "R:ADJ:FORM"), ("R:OTHER", [quick], [quickly], "R:MORPH"), ("R:OTHER", [big], [quick], "R:ADJ"),
        ("M:OTHER", [], [quickly], "M:ADV"), ("U:OTHER", [go], [], "U:VERB"), ("R:OTHER", [go], [cat], "R:OTHER"),
        ("R:ORTH", [go], [goes], "R:ORTH"), ("R:OTHER", None, [goes], "R:OTHER"), ("R:OTHER", [(None, None, None)], [go], "R:OTHER"),
        ("R:OTHER", [cat, cats], [dog], "R:NOUN"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, code string, o {READ}, c {READ}, want string")
    for r in df.withColumn("got", labels.pos_code(F.col("code"), F.col("o"), F.col("c"))).collect():
        assert r.got == r.want, r


def test_readings_go_along_with_both_sides_of_an_edit(spark):
    def tagged(text):
        forms = {"walk": ("VERB", "VBP", "walk"), "walks": ("VERB", "VBZ", "walk"), "fast": ("ADV", "RB", "fast"), "house": ("NOUN", "NN", "house"),
                 "houses": ("NOUN", "NNS", "house")}
        return [forms.get(w, ("X", "X", w)) for w in text.split(" ")]

    pairs = [("she walk to two house", "she walks to two houses"), ("she walks home", "she walks fast home"), ("same", "same")]
    plain = spark.createDataFrame(pairs, "original string, corrected string")
    rows = [(o, c, tagged(o), tagged(c)) for o, c in pairs]
    read = spark.createDataFrame(rows, f"original string, corrected string, original_readings {READ}, corrected_readings {READ}")
    got = edits.typed_matches(read)
    assert "original_readings" not in got.columns
    assert sorted(r.description for r in got.collect()) == ["Adverb", "Noun Number", "Subject–Verb Agreement"]
    assert [r.description for r in edits.typed_matches(plain).collect()] == ["Other / Uncategorized"] * 3
