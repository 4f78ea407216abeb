"""Edit codes and their labels.

The codes follow the usual scheme: ``M:``, ``U:`` or ``R:`` for missing, unneeded
and replaced, then a category. Categories come from surface form and closed word
classes only, so they agree with a linguistic annotator on those alone.
"""

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.functions import patterns as P
from redpen.operators.skew import key_counts, spread_join
from redpen.sources.sinks import shared_folder


def _labels() -> Column:
    return F.from_json(F.lit(json.dumps(P.ERROR_LABELS)), "map<string,string>")


def label_of(code: Column) -> Column:
    """Label of an edit code; codes without a prefix count as ``OTHER``."""
    bare = F.when(F.contains(code, F.lit(":")), F.regexp_replace(code, "^[^:]*:", "")).otherwise("OTHER")
    return F.coalesce(F.try_element_at(_labels(), bare), bare)


def edit_code(o_str: Column, c_str: Column, o_tok: Column, c_tok: Column) -> Column:
    """Code of an edit from its two texts and token arrays."""
    operation = F.when(o_str == "", "M").when(c_str == "", "U").otherwise("R")
    o_low, c_low = F.lower(o_str), F.lower(c_str)

    def bare(s: Column) -> Column:
        return F.regexp_replace(s, f"{P.WS}+", "")

    def both(pattern: str) -> Column:
        """Every side that has text matches the pattern."""
        return ((o_str == "") | o_str.rlike(pattern)) & ((c_str == "") | c_str.rlike(pattern))

    def in_class(words: list[str]) -> Column:
        """Every side that has text is one of the words."""
        listed = "^(?:" + "|".join(words) + ")?$"
        return o_low.rlike(listed) & c_low.rlike(listed)

    category = (
        F.when(bare(o_low) == bare(c_low), "ORTH")
        .when((F.size(o_tok) > 1) & (F.array_sort(o_tok) == F.array_sort(c_tok)), "WO")
        .when(both(r"^[^\p{L}\p{N}]+$"), "PUNCT")
        .when(both(r"^\p{N}[\p{N}.,]*$"), "NUM")
    )
    for name, words in P.CLOSED_CLASSES.items():
        category = category.when(in_class(words), name)
    return F.concat(operation, F.lit(":"), category.otherwise("OTHER"))


READING = "array<struct<pos:string,form:string,lemma:string>>"
_VERBS, _NOUNS = ("VERB", "AUX"), ("NOUN", "PROPN")


def pos_code(code: Column, o_read: Column, c_read: Column) -> Column:
    """An ``OTHER`` code made more precise by the readings of its tokens; any other code stays.

    A reading is one token's part of speech (VERB, AUX, NOUN, PROPN, ADJ, ADV, ...), form and
    lemma. Forms are the usual fine tags: VB, VBP, VBZ, VBD, VBG, VBN, NN, NNS, POS, JJ, JJR, JJS.
    One token for another of the same lemma is a change of form; agreement is VBZ against VB or VBP,
    tense is VBD against another form. Two parts of speech of one lemma are morphology.
    Otherwise all tokens of both sides must share their part of speech. Without readings, as
    where the user has none, the code stays.
    """
    one_each = (F.size(o_read) == 1) & (F.size(c_read) == 1)
    o, c = F.get(o_read, F.lit(0)), F.get(c_read, F.lit(0))
    same_lemma = one_each & (F.lower(o.lemma) == F.lower(c.lemma))

    def both_of(kinds: tuple[str, ...]) -> Column:
        return o.pos.isin(*kinds) & c.pos.isin(*kinds)

    def forms(a: tuple[str, ...], b: tuple[str, ...]) -> Column:
        return (o.form.isin(*a) & c.form.isin(*b)) | (o.form.isin(*b) & c.form.isin(*a))

    changed = ~o.form.eqNullSafe(c.form)
    formed = (
        F.when(both_of(_VERBS) & forms(("VBZ",), ("VB", "VBP")), "VERB:SVA")
        .when(both_of(_VERBS) & changed & ((o.form == "VBD") | (c.form == "VBD")), "VERB:TENSE")
        .when(both_of(_VERBS) & changed, "VERB:FORM")
        .when(both_of(_NOUNS) & changed & ((o.form == "POS") | (c.form == "POS")), "NOUN:POSS")
        .when(both_of(_NOUNS) & changed, "NOUN:NUM")
        .when(both_of(("ADJ",)) & changed, "ADJ:FORM")
        .when(o.pos != c.pos, "MORPH")
    )

    def all_of(kinds: tuple[str, ...]) -> Column:
        together = F.concat(o_read, c_read)
        return (F.size(together) > 0) & F.forall(together, lambda r: F.coalesce(r.pos.isin(*kinds), F.lit(False)))

    category = (
        F.when(same_lemma & formed.isNotNull(), formed)
        .when(all_of(_VERBS), "VERB").when(all_of(_NOUNS), "NOUN").when(all_of(("ADJ",)), "ADJ").when(all_of(("ADV",)), "ADV")
    )
    known = o_read.isNotNull() & c_read.isNotNull() & code.endswith(":OTHER") & category.isNotNull()
    return F.when(known, F.concat(F.substring(code, 1, 2), category)).otherwise(code)


def vocabulary(tokens: DataFrame, token: str = "token") -> DataFrame:
    """How often each lower-cased token occurs. Combined before the shuffle."""
    return tokens.groupBy(F.lower(token).alias("token")).agg(F.count("*").alias("n"))


def _kept(df: DataFrame, purpose: str) -> DataFrame:
    """Written once, read back."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spelling_codes(
    edits: DataFrame, vocab: DataFrame, rare: int = 1, common: int = 2, distance: int = 2
) -> DataFrame:
    """Turn ``R:OTHER`` into ``R:SPELL`` where a rare word became a close, common one.

    The edits and the vocabulary are read several times, so each becomes a table in the shared folder first.
    """
    edits, vocab = _kept(edits, "edits"), _kept(vocab, "vocabulary")
    old = vocab.select(F.col("token").alias("_o"), F.col("n").alias("_o_n"))
    new = vocab.select(F.col("token").alias("_c"), F.col("n").alias("_c_n"))
    df = edits.withColumns({"_o": F.lower("o_str"), "_c": F.lower("c_str")})
    word = "^" + P.WORD + "+$"
    # Only these can change. The others, missing and unneeded words among them, are not shuffled.
    candidate = F.coalesce((F.col("code") == "R:OTHER") & F.col("_o").rlike(word) & F.col("_c").rlike(word), F.lit(False))
    # The first join keeps the rows, so the counts of the second need not wait for it.
    by_new = key_counts(df.where(candidate), ["_c"])
    asked = spread_join(df.where(candidate), old, ["_o"], "left")
    asked = spread_join(asked, new, ["_c"], "left", by_new)
    spelling = (
        (F.coalesce("_o_n", F.lit(0)) <= rare)
        & (F.col("_c_n") >= common)
        & (F.levenshtein("_o", "_c") <= distance)
    )
    asked = asked.withColumn("code", F.when(spelling, "R:SPELL").otherwise(F.col("code")))
    return asked.select(*edits.columns).unionByName(df.where(~candidate).select(*edits.columns))
