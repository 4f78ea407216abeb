"""Match table derived from the corpus: three word-list correctors that overlap.

Corrector 0 puts articles and ``of`` in capitals, corrector 1 articles and ``and``,
corrector 2 rewrites the article. So the same match comes from two correctors, and
two different ones sit on the same span.
"""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.operators.edits import explode_matches

WORDS = {0: ["the", "of", "la", "der", "el"], 1: ["the", "and", "la", "der", "el"], 2: ["the", "la"]}
ITEM = "array<struct<offset:int,length:int,replacement:string,corrector_idx:int,match_idx:int>>"


def _flags(words: dict[int, list[str]]) -> Callable[[Column], Column]:
    """Arrow function over texts: the flags of each, null for a null text.

    Built in a closure so that it is sent by value. White space of ``str.split`` is that of ``patterns.WS``.
    """
    new = {idx: {w: w.upper() if idx < 2 else "ye" for w in listed} for idx, listed in words.items()}
    every = {w for listed in words.values() for w in listed}
    kinds = {
        "offset": pa.int32(), "length": pa.int32(), "replacement": pa.string(), "corrector_idx": pa.int32(),
        "match_idx": pa.int32(),
    }

    def flags(texts: pa.Array) -> pa.Array:
        ends, missing, rows = [0], [], []
        for text in texts.to_pylist():
            tokens = text.split() if text else []
            if not every.isdisjoint(tokens):
                at, found = 0, []
                for i, t in enumerate(tokens):
                    at = text.find(t, at)  # only white space lies between
                    if t in every:
                        found.append((at, len(t), t, i))
                    at += len(t)
                rows += [(at, n, own[t], idx, i) for idx, own in new.items() for at, n, t, i in found if t in own]
            ends.append(len(rows))
            missing.append(text is None)
        columns = zip(*rows) if rows else [()] * len(kinds)
        items = pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values())], list(kinds))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, mask=pa.array(missing, pa.bool_()))

    return F.arrow_udf(flags, ITEM)


def flagged(sentences: DataFrame) -> DataFrame:
    """Add ``matches``, the flags of all correctors in corrector, then token order."""
    return sentences.withColumn("matches", _flags(WORDS)(F.col("text")))


def flagged_rows(sentences: DataFrame, extra: list[str] | None = None) -> DataFrame:
    df = flagged(sentences).select("doc_id", "sent_idx", *(extra or []), "matches")
    return explode_matches(df, "matches", "_n").drop("_n")


def _sql() -> str:
    from redpen.catalog.base import SQL_NS, sql_token_rows

    parts = []
    for idx, words in WORDS.items():
        listed = ", ".join(f"'{w}'" for w in words)
        new = "upper(token)" if idx < 2 else "'ye'"
        parts.append(
            f"""SELECT doc_id, sent_idx, CAST({idx} AS BIGINT) AS corrector_idx, pos AS match_idx,
            start AS "offset", length(token) AS length, {new} AS replacement
            FROM flag_toks WHERE token IN ({listed})"""
        )
    toks = sql_token_rows("flag_toks", "sents", "text", SQL_NS + "+")
    return f"{toks},\n flags AS ({' UNION ALL '.join(parts)})"


FLAGS = _sql()
