"""Token starts and token diffs that work in one Arrow pass: results, and that the pass is there."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from redpen.functions import patterns as P
from redpen.functions import text as X
from redpen.functions.diff import differ, with_edits, with_hunk
from redpen.operators import apply, project
from redpen.operators import edits as E

ODD = "\u2003the  caf\u00e9 \x1cof\u00a0\U0001f600 the\n\nof "
TEXTS = [ODD, "", "  ", "no flag here", "the the of la der el and " * 40, None, "it's the (end), of it"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("library", [False, True])
def test_starts(spark, library):
    tok, pos, pieces = (X.lib_tokens, X.lib_token_starts, X.lib_pieces) if library else (X.ws_tokens, X.ws_token_starts, X.ws_pieces)
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    text = F.col("text")
    df = df.select(pos(text).alias("new"), X.starts_of(pieces(text), tok(text)).alias("old"))
    rows = df.collect()
    assert [r.new for r in rows] == [r.old for r in rows]
    assert "ArrowEvalPython" in _plan(df)


def test_texts_are_compared_like_their_tokens(spark):
    pairs = [("a  b c", "a x c"), ("a b", "a\u00a0b"), ("", "a"), (None, "a"), ("the the cat", "the cat the"), (" ", "")]
    df = spark.createDataFrame(pairs, "original string, fixed string")
    df = df.withColumns({"a_tok": X.ws_tokens(F.col("original")), "b_tok": X.ws_tokens(F.col("fixed"))})
    by_text, by_token = (with_hunk(df, *c).collect() for c in (("original", "fixed"), ("a_tok", "b_tok")))
    assert by_text == by_token
    assert with_edits(df, "original", "fixed").collect() == with_edits(df, "a_tok", "b_tok").collect()


def test_given_operations_need_no_pieces(spark):
    df = spark.createDataFrame([(1, "a  b", "b  a")], "doc_id int, original string, corrected string")
    ops = F.array(*[
        F.struct(F.lit(o).alias("op"), *[F.lit(v).alias(k) for k, v in zip(("i1", "i2", "j1", "j2"), at, strict=True)])
        for o, at in (("delete", (0, 1, 0, 0)), ("insert", (1, 1, 1, 2)))
    ]).cast("array<struct<op:string,i1:int,i2:int,j1:int,j2:int>>")
    out = E.merge_adjacent_ops(E.with_plain_tokens(df.withColumn("edits", ops), fix=False))
    assert "*+" not in _plan(out)  # the search for tokens with the spaces before them
    assert [(r.offset, r.length, r.replacement) for r in out.collect()] == [(0, 1, "a")]


def test_spaces_before_marks_go_in_one_search(spark):
    text = "a \u00a0. b ,c ? ! ;  : d : .x\n\n!? - e - f"
    expected = text
    for _, pattern, replacement in P.TOKENIZATION_FIXES:
        java = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), pattern).replace(r"\p{L}\p{N}_", r"\w")
        if "&&" not in java:
            expected = re.sub(java, re.sub(r"\$(\d)", r"\\\1", replacement), expected)
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(X.fix_tokenization(F.col("t")).alias("x")).first().x
    assert got == expected
    assert len(P.JAVA_FIXES) == len(P.TOKENIZATION_FIXES) - 4


@pytest.mark.parametrize("library", [False, True])
def test_every_token_has_its_start_beside_it(spark, library):
    """No list of all starts is copied for every token of a long text."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    tok, pos = (X.lib_tokens, X.lib_token_starts) if library else (X.ws_tokens, X.ws_token_starts)
    expected = [
        (r.id, i, t, s) for r in df.select("id", tok(F.col("text")).alias("t"), pos(F.col("text")).alias("s")).collect()
        for i, (t, s) in enumerate(zip(r.t or [], r.s or []))
    ]
    out = project.tokens(df, library=library)
    assert sorted(map(tuple, out.collect())) == expected
    assert "_starts" not in _plan(out)
    bare = project.tokens(df, library=library, starts=False)
    assert sorted(map(tuple, bare.collect())) == [r[:3] for r in expected] and "ArrowEvalPython" not in _plan(bare)


def _edited(rng):
    words = [f"w{i}" for i in range(rng.choice([1, 3, 20, 300]))]
    x = [rng.choice(words) for _ in range(rng.choice([0, 1, 4, 15, 40, 205, 260]))]
    y = list(x)
    for _ in range(rng.choice([0, 1, 2, 6])):
        k = rng.randrange(len(y) + 1)
        y[k:k + rng.choice([0, 1])] = rng.choice([[], [rng.choice(words)], ["q"], y[k:k + 1] * 2, [None]])
    return (x, y) if rng.random() < 0.5 else (y, x)


def test_certain_blocks_are_the_matchers(monkeypatch):
    """The edits are the matcher's, which is not asked where every block has a token of its own."""
    rng = random.Random(5)
    compared = differ()
    for _ in range(3000):
        x, y = _edited(rng)
        expected = [o for o in difflib.SequenceMatcher(None, x, y).get_opcodes() if o[0] != "equal"]
        assert [tuple(e) for e in compared(x, y)[3]] == expected
    monkeypatch.setattr(difflib.SequenceMatcher, "__init__", None)
    several, twice = "a b c d e f g h i".split(), "a b c c d e".split()
    assert differ()(several, "a b d e f h i".split())[3] == [("delete", 2, 3, 2, 2), ("delete", 6, 7, 5, 5)]
    assert differ()(twice, "a b c d e".split())[2:] == ("diff", [("delete", 3, 4, 3, 3)])


def test_plain_edits_and_matches_are_one_pass(spark):
    """Tokens, diff and matches of texts come from one Arrow function; no pattern searches for tokens beside it."""
    df = spark.createDataFrame(
        [(1, "a  b c", "a\u2003x  y c"), (2, "a b a b", "b a"), (3, "a", "a"), (4, None, "a"), (5, "", "new one"), (6, "x  b", "b")],
        "id int, original string, corrected string")
    matched, edited = E.with_plain_matches(df, fix=False), E.with_plain_edits(df, fix=False)
    for out in (matched, edited, E.with_plain_matches(df), E.with_plain_edits(df)):
        assert "regexp_extract_all" not in _plan(out) and _plan(out).count("ArrowEvalPython") == 1
    got = {r.id: [tuple(m) for m in r.matches] for r in matched.collect()}
    assert got == {
        1: [("replace", 3, 1, "x  y", "x  y", 1)], 2: [("delete", 0, 3, "b", "b", None), ("delete", 4, 3, "a", "a", None)],
        3: [], 4: [], 5: [], 6: [("delete", 0, 4, "b", "b", None)],
    }
    rows = {r.id: r for r in edited.collect()}
    assert rows[1].b_tok == ["a", "x", "y", "c"] and rows[5].a_tok == [] and rows[3].a_tok is None and rows[4].b_tok is None


def test_filter_on_the_route_does_not_run_the_diff_twice(spark):
    df = spark.createDataFrame([("a b", "a c")], "a string, b string")
    out = with_hunk(df, "a", "b").where(F.col("_route") == "hunk")
    assert _plan(out).count("ArrowEvalPython") == 1 and out.first()["_edits"][0][1:] == (1, 2, 1, 2)


def test_a_match_on_its_own_is_not_sorted(spark):
    df = spark.createDataFrame([("abc", [(1, 1, "x")]), ("abc", [(3, 1, "x")])], "text string, matches " + apply.SPAN)
    assert [(r.applied, r.n_applied) for r in apply.apply_matches(df).collect()] == [("axc", 1), ("abc", 0)]
    assert "< 2" in _plan(apply.apply_matches(df))


def test_stable_characters_are_the_same_kind_for_java_and_python(spark):
    stable = [chr(c) for c in [*range(0x590), *range(0x2000, 0x2070), *range(0x1F300, 0x1F650)]]
    df = spark.createDataFrame([(c,) for c in stable], "c string")
    c = F.col("c")
    rows = df.select("c", c.rlike(P.WORD).alias("w"), c.rlike(P.WS).alias("s"), c.rlike(P.NOT_STABLE).alias("odd")).collect()
    assert len(rows) == len(stable) and not any(r.odd for r in rows)
    assert [r.c for r in rows if r.w != bool(re.fullmatch(r"\w", r.c)) or r.s != bool(re.fullmatch(r"\s", r.c))] == []


def test_typed_edits_are_one_pass(spark):
    """Library tokens, diff, split and spans come from one Arrow function; texts with rare letters bring their tokens."""
    pairs = [
        ("it's their  house", "its there house"), ("We can't go", "We cannot go ."), ("a \U00031350 b", "a \U00031350 c"), ("the 中文 x", "the 中 x"),
        ("café (x)", "café (y) \U0001f600"), ("same", "same"), (None, "x"), ("x", None), ("", "new one"), ("gone", ""), ("  ", "'s"),
    ]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, original string, corrected string")
    out = E.with_typed_edits(df, fix=False)
    assert _plan(out).count("ArrowEvalPython") == 1 and "sequence(" not in _plan(out)
    tok = {c: X.lib_tokens(F.col(c)) for c in ("original", "corrected")}
    sides = {r.id: r for r in df.select("id", *[t.alias(c) for c, t in tok.items()]).collect()}
    differ_ = differ()
    for r in out.collect():
        x, y = sides[r.id].original, sides[r.id].corrected
        if x is None or y is None or r.original == r.corrected:
            assert r.n_tokens is None and r.edits == []
            continue
        assert r.n_tokens == len(x)
        rebuilt, at = [], 0
        for e in r.edits:
            assert "".join(e.o_str.split()) == "".join(x[e.o_start:e.o_end])
            assert r.original[e.span_offset:e.span_offset + e.span_length] == e.o_str
            assert e.next_token == (x[e.o_start] if e.o_start < len(x) else None)
            assert e.prev_token == (x[e.o_start - 1] if e.o_start else None)
            assert e.prev_token is None or r.original[e.prev_offset:].startswith(e.prev_token)
            rebuilt += [*x[at:e.o_start], e.c_str]
            at = e.o_end
        assert "".join("".join([*rebuilt, *x[at:]]).split()) == "".join(y)
        assert bool(r.edits) == bool(differ_(x, y)[3])


def test_no_list_is_handed_over_to_the_typed_pass(spark):
    """The size of a list is worked out anew for every row of a batch: the square of the batch."""
    df = spark.createDataFrame([(1, "a b", "a c")], "id int, original string, corrected string")
    plan = _plan(E.with_typed_edits(df))
    line = next(x for x in plan.splitlines() if "ArrowEvalPython" in x)
    assert "array_join(" in line and "THEN array_join(" in line and "_tok" not in line


def test_clean_up_steps_are_walked_only_beside_white_space(spark):
    """The same text as by all steps in a row, whatever stands beside white space."""
    rng = random.Random(3)
    pieces = ["a", "B", "é", "7", "_", "'", '"', "-", ":", ".", ",", "!", "?", ";", " ", "  ", "\n", "\u00a0", "\u2003", "中"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(3000)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    step_by_step = F.col("t")
    for _, pattern, replacement in P.TOKENIZATION_FIXES:
        step_by_step = F.regexp_replace(step_by_step, pattern, replacement)
    rows = df.select("t", X.fix_tokenization(F.col("t")).alias("got"), step_by_step.alias("expected")).collect()
    assert [r for r in rows if r.got != r.expected] == []
    assert "ELSE CASE WHEN" in df.select(X.fix_tokenization(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
