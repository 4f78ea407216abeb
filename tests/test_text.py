import random
import re

from pyspark.sql import functions as F

from redpen.functions import patterns as P
from redpen.functions import text as X
from redpen.operators import project

ODD = [" ", "　", "\x1f", "\x85", "é", "²", "Ⅷ", "४", "😀", "​", "漢字", "'", '"', " ", "-", ".", ":", "a", "B", "_"]


def strings(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD + [" ", " "], k=rng.randrange(0, 25))) for _ in range(n)]


def test_fix_tokenization_golden(spark):
    same = ['They called " wait "', "rows 3 - 9", "8 - 2 = 6", "p + q", ": )", ": ("]
    cases = [(s, s) for s in same] + [
        ("We know that 's late", "We know that's late"), ("I ' m early", "I'm early"),
        ("They ' re singing", "They're singing"), ("We 'll wait", "We'll wait"), ("We saw birds .", "We saw birds."),
        ("Old boats . ", "Old boats. "), ("Red , blue , green", "Red, blue, green"),
        ("I ' m early .", "I'm early."), ("Where were you ?", "Where were you?"),
        ("We waited ; nobody", "We waited; nobody"), ("Mind these rows :", "Mind these rows:"),
        ("long - lost friend", "long-lost friend"), ("out - of - town", "out-of-town"),
        ("That 's late !", "That's late!"),
    ]
    df = spark.createDataFrame(cases, "raw string, expected string")
    got = df.select("raw", "expected", X.fix_tokenization(F.col("raw")).alias("got")).collect()
    assert [(r.raw, r.got) for r in got] == cases


def test_tokens_and_offsets_match_python(spark):
    texts = strings(1, 400) + ["", " ", "word " * 300, "a\tb  c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select(
        "id", X.ws_tokens(F.col("text")).alias("t"), X.ws_token_starts(F.col("text")).alias("s"),
        X.rstrip(F.col("text")).alias("r"), X.strip(F.col("text")).alias("b"), X.squeeze(F.col("text")).alias("q"),
        X.lib_tokens(F.col("text")).alias("lt"), X.lib_token_starts(F.col("text")).alias("ls"),
    ).collect()
    for r in rows:
        text = texts[r.id]
        assert r.t == text.split()
        assert r.r == text.rstrip() and r.b == text.strip() and r.q == " ".join(text.split())
        assert all(text[p : p + len(t)] == t for p, t in zip(r.s, r.t)) and len(r.s) == len(r.t)
        assert all(text[p : p + len(t)] == t for p, t in zip(r.ls, r.lt)) and len(r.ls) == len(r.lt)
        assert "".join(r.lt) == "".join(text.split())


def test_lib_tokens_split_clitics(spark):
    df = spark.createDataFrame([("We can't say it's Anna's, you'll see.",)], "text string")
    got = df.select(X.lib_tokens(F.col("text")).alias("t")).first().t
    assert got == ["We", "ca", "n't", "say", "it", "'s", "Anna", "'s", ",", "you", "'ll", "see", "."]


def test_sentences(spark):
    docs = [(1, "A b. C\nd. "), (2, ""), (3, "One"), (4, "x. y. z")]
    rows = project.sentences(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = sorted((r.doc_id, r.sent_idx, r.text, r.sent_start) for r in rows)
    assert got == [(1, 0, "A b", 0), (1, 1, "C\nd", 5), (1, 2, "", 10), (3, 0, "One", 0),
                   (4, 0, "x", 0), (4, 1, "y", 3), (4, 2, "z", 6)]


def test_prompt_keeps_special_characters(spark):
    df = spark.createDataFrame([(r"cost \1 $1 {{ x }}",)], "text string")
    row = df.select(X.render_prompt(F.col("text"), "Fix grammar: {{ text }}").alias("p"),
                    X.render_prompt(F.col("text"), None).alias("q")).first()
    assert row.p == r"Fix grammar: cost \1 $1 {{ x }}" and row.q == r"cost \1 $1 {{ x }}"


def test_emoji_normalisation(spark):
    cases = ["Great 👍🏽", "❤️ y", "👨‍👩‍👧 picture", "🟢 ready", "all 🟢 good", "漢字"]
    df = spark.createDataFrame([(c,) for c in cases], "text string")
    got = [tuple(r) for r in df.select(X.normalise_emoji(F.col("text")), X.normalise_emoji(F.col("text"), True)).collect()]
    loose = ["Great", "y", "picture", "ready", "all good", ""]
    assert [g[0] for g in got] == loose
    assert [g[1] for g in got] == loose[:-1] + ["漢字"]


def test_utf16_offset(spark):
    text = "a😀b"
    row = spark.createDataFrame([(text, 2)], "t string, o int").select(X.utf16_offset(F.col("t"), F.col("o")).alias("u")).first()
    assert row.u == 3 and re.match("b", text[2:])


def test_java_classes_hold_the_same_characters(spark):
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x30000)]))
    df = spark.createDataFrame([(every,)], "t string")
    for plain, java in [(P.WS, P.JAVA_WS), (P.WORD, P.JAVA_WORD)]:
        row = df.select(F.regexp_replace("t", plain, "").alias("a"), F.regexp_replace("t", java, "").alias("b")).first()
        assert row.a == row.b and row.a != every


def test_java_runs_find_the_same_tokens(spark):
    # Every character between two letters and alone, so that each class meets each other one.
    every = "".join(f"x{c}y {c} " for c in map(chr, [*range(0xD800), *range(0xE000, 0x12000)]))
    df = spark.createDataFrame([(every,), ("",), (" \u2003",), (None,)], "t string")
    mark = r"[^\p{L}\p{N}_" + P.WS[1:]
    for plain, java in [
        (f"{P.NS}+", P.JAVA_NS_RUN), (f"{P.WS}*{P.NS}+", f"{P.JAVA_WS}*+{P.JAVA_NS_RUN}"),
        (f"(?:{P.WORD}+|{mark})", P.PLAIN_TOKEN), (f"{P.WS}*(?:{P.WORD}+|{mark})", f"{P.JAVA_WS}*+{P.PLAIN_TOKEN}"),
    ]:
        found = [F.regexp_extract_all("t", F.lit(x), F.lit(0)).alias(n) for n, x in (("a", plain), ("b", java))]
        rows = df.select(*found).collect()
        assert all(r.a == r.b for r in rows) and len(rows[0].b) > 1000


def test_long_runs_need_no_stack(spark):
    text = "a\u00e9\u4e2d" * 100_000
    row = spark.createDataFrame([(text,)], "t string").select(
        X.ws_tokens(F.col("t")).alias("w"), X.lib_tokens(F.col("t")).alias("l"), X.ws_token_starts(F.col("t")).alias("s")
    ).first()
    assert row.w == row.l == [text] and row.s == [0]


def test_starts_nobody_asks_for_are_not_computed(spark):
    docs = spark.createDataFrame([(1, "a b. c", "en", "s")], "doc_id long, text string, lang string, source string")
    sentences = project.sentences(docs)
    lean = sentences.select("doc_id", "sent_idx", "text")
    words = project.tokens(lean).groupBy("token").count()
    for df in (lean, words):
        assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in sentences.select("sent_idx", "text", "sent_start").orderBy("sent_idx").collect()] == [
        (0, "a b", 0), (1, "c", 5)]
    assert [tuple(r) for r in project.tokens(lean).orderBy("sent_idx", "pos").select("pos", "token", "start").collect()] == [
        (0, "a", 0), (1, "b", 2), (0, "c", 0)]
