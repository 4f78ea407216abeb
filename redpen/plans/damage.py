"""Rewrite pairs derived from a corpus, with a known damage per sentence.

The corpus has no corrections of its own. ``corrected`` is the clean sentence
spaced the way a generation model spaces it; ``original`` is the clean sentence
with one damage.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.functions import patterns as P
from redpen.functions import text as X
from redpen.operators.project import sentences


def clean_sentences(documents: DataFrame) -> DataFrame:
    """Non-blank sentences with ``tok``, ``n`` and a damage position ``k``."""
    # A filter on the tokens would be moved below them and find them a second time.
    df = sentences(documents).where(F.col("text").rlike(P.JAVA_NS_RUN))
    df = df.withColumn("tok", X.ws_tokens(F.col("text")))
    n = F.size("tok")
    k = (F.col("doc_id") * 31 + F.col("sent_idx") * 7) % n
    return df.select(
        "doc_id", "sent_idx", "lang", "source", F.array_join("tok", " ").alias("clean"), "tok",
        n.alias("n"), k.cast("int").alias("k"),
    )


def spaced(text: Column) -> Column:
    """A space before punctuation, as generation models emit it."""
    return F.regexp_replace(text, r"(\p{L})([.,?!;:])", "$1 $2")


def _reversed(t: Column, i: Column) -> Column:
    return F.when(i == F.col("k"), F.reverse(t)).otherwise(t)


def _before(new: Callable[[Column], Column]) -> Column:
    """All tokens, with one more before token ``k``."""
    return F.flatten(
        F.transform("tok", lambda t, i: F.when(i == F.col("k"), F.array(new(t), t)).otherwise(F.array(t)))
    )


# The damaged tokens of each kind: token ``k`` reversed, missing, after a foreign one, twice;
# every eleventh token missing, which makes several hunks.
DAMAGED: dict[str, Callable[[], Column]] = {
    "substituted": lambda: F.transform("tok", _reversed),
    "dropped": lambda: F.filter("tok", lambda t, i: i != F.col("k")),
    "inserted": lambda: _before(lambda t: F.lit("zzq")),
    "doubled": lambda: _before(lambda t: t),
    "thinned": lambda: F.filter("tok", lambda t, i: (F.col("doc_id") * 31 + F.col("sent_idx") * 7 + i) % 11 != 0),
}


def damaged(df: DataFrame, kinds: list[str]) -> DataFrame:
    """One row per sentence and kind of damage, from one pass: kind, original, corrected."""
    each = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.array_join(DAMAGED[k](), " ").alias("original")) for k in kinds
    ])
    return df.select("doc_id", "sent_idx", spaced(F.col("clean")).alias("corrected"), F.inline_outer(each))


def _of(kind: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: damaged(df, [kind]).select("doc_id", "sent_idx", "original", "corrected")


substituted, dropped, inserted, doubled, thinned = map(_of, DAMAGED)


def edges(df: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Damage at the edges of a sentence, one row per kind; only the ``wanted`` kinds if given.

    Lower-cased first letter, missing final period, missing final colon, trailing
    spaces before a colon, and a removed emoji.
    """
    clean = F.col("clean")
    first, rest = F.substring(clean, F.lit(1), F.lit(1)), F.substring(clean, F.lit(2), F.length(clean))
    kinds = F.array(
        *[
            F.struct(F.lit(name).alias("kind"), original.alias("original"), corrected.alias("corrected"))
            for name, original, corrected in [
                ("case", F.concat(F.lower(first), rest), F.concat(F.upper(first), rest)),
                ("period", clean, F.concat(clean, F.lit("."))),
                ("colon", clean, F.concat(clean, F.lit(":"))),
                ("spaces", F.concat(clean, F.lit("  ")), F.concat(clean, F.lit(":"))),
                ("emoji", F.concat(clean, F.lit(" 😀")), clean),
            ]
            if wanted is None or name in wanted
        ]
    )
    return df.select("doc_id", "sent_idx", F.explode_outer(kinds).alias("x")).select(
        "doc_id", "sent_idx", "x.kind", "x.original", "x.corrected"
    )


def known_edits(df: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Typed edits whose span is known by construction, one row per kind; only the ``wanted`` kinds if given.

    Columns as the typed extractor leaves them, plus the token arrays of both
    sides: a new first letter case, an appended period and colon, a colon in
    place of trailing spaces, a changed emoji, a reversed token, a missing token
    and two swapped tokens.
    """
    df = df.withColumn("t", X.lib_tokens(F.col("clean")))
    df = df.withColumn("p", X.starts_in(F.col("clean"), F.col("t")))
    n = F.size("t")
    k = ((F.col("doc_id") * 31 + F.col("sent_idx") * 7) % n).cast("int")
    df = df.withColumns({"n_tokens": n, "k": k})
    clean, t, k, n = F.col("clean"), F.col("t"), F.col("k"), F.col("n_tokens")
    none = F.array().cast("array<string>")
    head = F.get(t, F.lit(0))
    turned = F.concat(F.upper(F.substring(head, 1, 1)), F.substring(head, F.lit(2), F.length(head)))
    two = F.slice(t, k + 1, F.lit(2))

    def edit(kind, original, start, end, o_tok, c_tok):
        return kind, F.struct(
            F.lit(kind).alias("kind"), original.alias("original"), start.alias("o_start"),
            end.alias("o_end"), F.array_join(o_tok, " ").alias("o_str"),
            F.array_join(c_tok, " ").alias("c_str"), o_tok.alias("o_tok"), c_tok.alias("c_tok"),
        )

    at_end = [
        ("period", clean, "."), ("colon", clean, ":"), ("spaces", F.concat(clean, F.lit("  ")), ":"),
        ("emoji", clean, "😀"),
    ]
    kinds = [edit("case", clean, F.lit(0), F.lit(1), F.array(head), F.array(turned))]
    kinds += [edit(name, text, n, n, none, F.array(F.lit(new))) for name, text, new in at_end]
    kinds += [
        edit("reversed", clean, k, k + 1, F.array(F.get(t, k)), F.array(F.reverse(F.get(t, k)))),
        edit("missing", clean, k, k, none, F.array(F.get(t, k))),
        edit("unneeded", clean, k, k + 1, F.array(F.get(t, k)), none),
        edit("swapped", clean, k, F.least(k + 2, n), two, F.reverse(two)),
    ]
    kept = [x for kind, x in kinds if wanted is None or kind in wanted]
    rows = df.select("doc_id", "sent_idx", "n_tokens", "t", "p", F.explode_outer(F.array(*kept)).alias("x"))
    return rows.select("doc_id", "sent_idx", "n_tokens", "t", "p", "x.*")
