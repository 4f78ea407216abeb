"""The flags of the catalog: one Arrow pass, no lambda on every token."""

from redpen.catalog.flags import WORDS, flagged
from redpen.functions import patterns as P

ODD = "\u2003the  caf\u00e9 \x1cof\u00a0\U0001f600 the\n\nof "
TEXTS = [ODD, "", "  ", "no flag here", "the the of la der el and " * 40, None, "it's the (end), of it"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_python_and_the_patterns_agree_on_white_space():
    assert {chr(c) for c in range(0x110000) if chr(c).isspace()} == set(P.WS_CHARS)


def test_flags(spark):
    def expected(text):
        if text is None:
            return None
        out, words, at = [], [], 0
        for i, t in enumerate(text.split()):
            at = text.index(t, at)
            words.append((at, i, t))
            at += len(t)
        for idx, listed in WORDS.items():
            out += [(at, len(t), t.upper() if idx < 2 else "ye", idx, i) for at, i, t in words if t in listed]
        return out

    df = flagged(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    assert "ArrowEvalPython" in _plan(df) and "transform(" not in _plan(df)  # no lambda runs on every token
    got = {r.doc_id: r.matches and [tuple(m) for m in r.matches] for r in df.collect()}
    assert got == {i: expected(t) or (None if t is None else []) for i, t in enumerate(TEXTS)}
