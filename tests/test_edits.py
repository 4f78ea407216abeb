import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from redpen.functions import text as X
from redpen.functions.diff import with_edits, with_hunk
from redpen.operators import edits as E
from redpen.operators import labels, project

PAIR = "case_id int, original string, corrected string"


def pairs(spark, cases):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], PAIR)


def grouped(rows, *names):
    out = {}
    for r in sorted(rows, key=lambda r: (r.case_id, r.match_idx)):
        out.setdefault(r.case_id, []).append(tuple(r[n] for n in names))
    return out


GOLDEN = [
    ("they was late", "they were late", [(5, 3, "were")]), ("We went went", "We went", [(3, 9, "went")]),
    ("a big big dog", "a big dog", [(2, 7, "big")]), ("We late", "We were late", [(3, 4, "were late")]),
    ("cold", "quite cold", [(0, 4, "quite cold")]), ("old house", "old garden", [(4, 5, "garden")]),
    ("", "", []), ("   ", "   ", []), ("no change", "no change", []), ("quite cold", "cold", [(0, 10, "cold")]),
    ("Q Z R", "P Q R", [(0, 1, "P Q"), (0, 3, "Q")]), ("You saw", "You saw birds .", [(4, 3, "saw birds.")]),
]


def test_plain_golden(spark):
    rows = E.plain_matches(pairs(spark, [(a, b) for a, b, _ in GOLDEN])).collect()
    got = grouped(rows, "offset", "length", "replacement")
    assert [got.get(i, []) for i in range(len(GOLDEN))] == [g[2] for g in GOLDEN]


def test_min_length(spark):
    assert E.plain_matches(pairs(spark, [("a b", "x b")]), min_length=2).count() == 0
    assert E.plain_matches(pairs(spark, [("a b", "x b")]), min_length=0).count() == 1


def random_pair(rng):
    """A sentence over a small vocabulary, and a damaged copy."""
    vocab = [f"w{i}" for i in range(rng.choice([3, 6, 15, 60]))]
    a = rng.choices(vocab, k=rng.randrange(0, 30))
    b = list(a)
    for _ in range(rng.randrange(0, 3)):
        at = rng.randrange(0, len(b) + 1)
        kind = rng.randrange(4)
        if kind == 0:
            b[at:at] = rng.choices(vocab + ["new"], k=rng.randrange(1, 3))
        elif kind == 1:
            del b[at : at + rng.randrange(1, 3)]
        elif kind == 2:
            b[at : at + 1] = [rng.choice(vocab + ["new", "other"])]
        else:
            b[at : at + 2] = b[at : at + 2][::-1]
    return a, b


def test_diff_equals_standard_library(spark):
    rng = random.Random(7)
    data = [(i, *random_pair(rng)) for i in range(20000)]
    long = [f"t{i % 7}" for i in range(260)]
    data += [(len(data), long, long[:100] + ["x"] + long[100:]), (len(data) + 1, long, long[5:])]
    df = spark.createDataFrame(data, "id int, a array<string>, b array<string>").repartition(4)
    routes = {r["_route"]: r["count"] for r in with_hunk(df, "a", "b").groupBy("_route").count().collect()}
    assert routes["hunk"] > 3000 and routes["diff"] > 1000
    for r in with_edits(df, "a", "b").collect():
        want = [c for c in SequenceMatcher(None, r.a, r.b).get_opcodes() if c[0] != "equal"]
        assert [tuple(e) for e in r.edits] == want, (r.a, r.b)


def brute_force(original, corrected, min_length=1):
    """Plain matches by a direct reading of the rules."""
    def tokenise(s):
        out, at = [], 0
        for t in s.split():
            at = s.index(t, at)
            out.append((t, at))
            at += len(t)
        return out

    a, b = tokenise(original), tokenise(corrected)
    at, end = (lambda i: a[i][1]), (lambda i: a[i][1] + len(a[i][0]))
    out = []
    for op, i1, i2, j1, j2 in SequenceMatcher(None, [t for t, _ in a], [t for t, _ in b]).get_opcodes():
        new = corrected[b[j1][1] : b[j2 - 1][1] + len(b[j2 - 1][0])] if j2 > j1 else ""
        if op == "replace" and end(i2 - 1) - at(i1) >= min_length:
            out.append((at(i1), end(i2 - 1) - at(i1), new))
        elif op == "insert" and i1 < len(a):
            out.append((at(i1), len(a[i1][0]), new + " " + a[i1][0]))
        elif op == "insert" and i1 > 0:
            out.append((at(i1 - 1), len(a[i1 - 1][0]), a[i1 - 1][0] + " " + new))
        elif op == "delete" and i1 > 0 and end(i2 - 1) - at(i1 - 1) >= min_length:
            out.append((at(i1 - 1), end(i2 - 1) - at(i1 - 1), a[i1 - 1][0]))
        elif op == "delete" and i2 < len(a) and end(i2) - at(i1) >= min_length:
            out.append((at(i1), end(i2) - at(i1), a[i2][0]))
    return out


@pytest.mark.parametrize("min_length", [1, 4])
def test_plain_matches_against_brute_force(spark, min_length):
    rng = random.Random(min_length)
    cases = []
    for _ in range(1500):
        a, b = random_pair(rng)
        joins = [rng.choice([" ", "  ", "　"]) for _ in range(2)]
        cases.append((joins[0].join(a), joins[1].join(b)))
    # Many edits in one row: offsets come from the array of all starts.
    many = [f"u{i}" for i in range(120)]
    cases.append((" ".join(many), " ".join(t if i % 3 else t + "x" for i, t in enumerate(many))))
    rows = E.plain_matches(pairs(spark, cases).repartition(4), min_length, fix=False).collect()
    got = grouped(rows, "offset", "length", "replacement")
    for i, (a, b) in enumerate(cases):
        assert got.get(i, []) == brute_force(a, b, min_length), (a, b)


SUPPRESSED = [
    ("row two there", "Row two there"), ("these are a few table rows", "These are a few table rows"),
    ("Price table", "Price table:"), ("These were our prices", "These were our prices:"), ("Rain is wet", "Rain is wet."),
    ("Our boat left the harbour early on Monday", "Our boat left the harbour early on Monday."),
    ("Price table ", "Price table:"), ("Those are rows   ", "Those are rows:"), ("Morning 😊", "Morning 😃"),
    ("Great 👍", "Great 👍🏽"), ("Love ❤️", "Love"), ("our 👨‍👩‍👧 picture", "our picture"),
    ("🟢 ready", "ready"), ("all 🟢 good", "all good"), ("blue boat", "Blue boat."), ("price table", "Price table:"),
    ("Red blue green white black brown ", "Red blue green white black brown:"),
]
KEPT = [
    ("our neighbours painted their old fence yesterday", "Our neighbours painted their old fence yesterday", ["Our"]),
    ("There was our table of prices", "There was our table of prices:", ["prices :"]),
    ("Price table there", "Price: table there", [": table"]), ("Ask why", "Ask: why", [": why"]),
    ("Our small boat left the quiet harbour early on a very cold morning",
     "Our small boat left the quiet harbour early on a very cold morning.", ["morning ."]),
    ("They was late", "They were late 😊", ["were"]), ("sing on", "sings on", ["sings"]),
    ("an old boat", "an older boat", ["older"]), ("its there boat", "It's their boat", ["It's", "their"]),
    ("We saw two birds", "We saw birds", []),
]


def test_suppression_tables(spark):
    assert E.typed_matches(pairs(spark, SUPPRESSED)).count() == 0
    rows = E.typed_matches(pairs(spark, [(a, b) for a, b, _ in KEPT])).collect()
    got = grouped(rows, "replacement")
    assert [[x[0] for x in got.get(i, [])] for i in range(len(KEPT))] == [k[2] for k in KEPT]


def test_typed_output_fields(spark):
    row = E.typed_matches(pairs(spark, [("We found the boats", "We found a boats")]), rule_id="R").first()
    assert (row.offset, row.length, row.replacement, row.rule_id, row.match_type) == (9, 3, "a", "R", 2)
    assert row.message == row.description == "Determiner / Article"


def test_unneeded_word_is_kept_by_plain_and_dropped_by_typed(spark):
    df = pairs(spark, [("We saw the old boat", "We saw the boat")])
    assert E.plain_matches(df).count() == 1 and E.typed_matches(df).count() == 0


def test_codes_and_spelling(spark):
    def code(o, c):
        return (o, c, o.split(), c.split())

    cases = [code("the", "a"), code("", "of"), code("Their", "their"), code("a b", "b a"), code(",", "."),
             code("10", "11"), code("his", ""), code("runs", "ran"), code("all ready", "allready")]
    df = spark.createDataFrame(cases, "o_str string, c_str string, o_tok array<string>, c_tok array<string>")
    got = [r[0] for r in df.select(labels.edit_code(*(F.col(c) for c in df.columns))).collect()]
    assert got == ["R:DET", "M:PREP", "R:ORTH", "R:WO", "R:PUNCT", "R:NUM", "U:PRON", "R:OTHER", "R:ORTH"]
    edits = spark.createDataFrame([("teh", "tea", "R:OTHER"), ("runs", "ran", "R:OTHER")], "o_str string, c_str string, code string")
    corpus = spark.createDataFrame([("tea tea ran runs runs",)], "text string")
    out = labels.spelling_codes(edits, labels.vocabulary(project.tokens(corpus, library=True)))
    assert {r.o_str: r.code for r in out.collect()} == {"teh": "R:SPELL", "runs": "R:OTHER"}


def test_labels(spark):
    df = spark.createDataFrame([("R:DET",), ("M:NOUN:POSS",), ("R:QQ:Z",), ("DET",)], "code string")
    got = [r[0] for r in df.select(labels.label_of(F.col("code"))).collect()]
    assert got == ["Determiner / Article", "Noun Possessive", "QQ:Z", "Other / Uncategorized"]


def test_filter_on_matches_does_not_copy_the_diff(spark):
    df = E.with_typed_matches(pairs(spark, [("a b", "a c")])).where(F.size("matches") > 0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and df.count() == 1
    assert "Exchange" not in plan


def test_running_sums_blocks(spark):
    values = [list(range(n)) for n in (0, 1, 31, 32, 33, 1000)]
    df = spark.createDataFrame([(v,) for v in values], "v array<int>")
    for row in df.select("v", X.running_sums(F.col("v")).alias("s")).collect():
        assert row.s == [sum(row.v[: i + 1]) for i in range(len(row.v))]


def test_diff_is_one_arrow_pass(spark):
    """The work on token arrays is in one Arrow function, not in functions the JVM interprets per element."""
    df = spark.createDataFrame([(["a", "b"], ["a"]), (None, ["a"])], "a array<string>, b array<string>")
    plan = with_edits(df, "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambdafunction" not in plan
    assert [[tuple(e) for e in r.edits] for r in with_edits(df, "a", "b").collect()] == [[("delete", 1, 2, 1, 1)], []]


def test_plain_matches_tell_their_route(spark):
    """The route comes with the matches: pairs are not diffed twice and joined."""
    df = spark.createDataFrame([(1, "a b c", "a x c"), (2, "a b a b", "b a"), (3, "a", "a")], "id int, original string, corrected string")
    out = E.with_plain_matches(df, route="route")
    assert {r.id: r.route for r in out.collect()} == {1: "hunk", 2: "diff", 3: "equal"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("ArrowEvalPython") == 1


def test_spelling_works_out_its_edits_once(spark):
    edits = spark.createDataFrame([(1, "elpa", "apple", "R:OTHER")], "id long, o_str string, c_str string, code string")
    edits = edits.withColumn("o_str", F.reverse("o_str"))
    vocab = spark.createDataFrame([("apple", 5)], "token string, n long")
    out = labels.spelling_codes(edits, vocab)
    assert "reverse(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in out.select("id", "o_str", "code").collect()] == [(1, "aple", "R:SPELL")]
