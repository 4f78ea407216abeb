"""Column expressions over text: tokens, offsets, clean-up, stripping."""

import functools
import operator
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.functions import patterns as P

# Running sums are folded in blocks so that one very long row costs n * BLOCK
# element copies, not n * n.
BLOCK = 32


def _fold_sums(values: Column) -> Column:
    return F.aggregate(
        values,
        F.array().cast("array<int>"),
        lambda acc, x: F.concat(
            acc, F.array((F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x).cast("int"))
        ),
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hold(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns so that later filters on them are not rewritten in terms of their inputs.

    The optimizer moves a filter below a projection by copying the expression,
    which multiplies nested array expressions. It does not move one below a
    generator, so the columns pass through a generator of one row.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    held = df.select(*kept, F.explode_outer(F.array(row)).alias("_held"))
    return held.select(*kept, *[F.col(f"_held.{name}").alias(name) for name in columns])


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an int array, in the row."""

    def blocked(v: Column) -> Column:
        n_blocks = F.ceil(F.size(v) / F.lit(BLOCK)).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), n_blocks - 1),
            lambda b: _fold_sums(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))),
        )

        def shifted(bs: Column) -> Column:
            totals = F.transform(bs, lambda b: F.get(b, F.size(b) - 1))
            shifts = F.slice(
                F.concat(F.array(F.lit(0)), _fold_sums(totals)), F.lit(1), F.size(bs)
            )
            return F.flatten(F.zip_with(bs, shifts, lambda b, s: F.transform(b, lambda x: x + s)))

        return let(blocks, shifted)

    return let(
        values, lambda v: F.when(F.size(v) <= BLOCK, _fold_sums(v)).otherwise(blocked(v))
    )


def starts_of(pieces: Column, tokens: Column) -> Column:
    """Start offset of every token. ``pieces`` are the tokens with their leading whitespace."""
    ends = running_sums(F.transform(pieces, lambda p: F.length(p)))
    return F.zip_with(ends, tokens, lambda e, t: e - F.length(t))


def _starts_in() -> Callable[..., Column]:
    """Arrow function over texts and their tokens; without tokens those between white space.

    Built in a closure so that it is sent by value. White space of ``str.split`` is that of ``patterns.WS``.
    """

    def starts(texts: pa.Array, *tokens: pa.Array) -> pa.Array:
        words = tokens[0].values.to_numpy(zero_copy_only=False).tolist() if tokens else []
        bounds = tokens[0].offsets.to_pylist() if tokens else []
        valid = tokens[0].is_valid().to_pylist() if tokens else []
        ends, missing, found = [0], [], []
        for row, text in enumerate(texts.to_pylist()):
            none = text is None or (bool(tokens) and not valid[row])
            if not none:
                at = 0
                for t in words[bounds[row]:bounds[row + 1]] if tokens else text.split():
                    at = text.find(t, at)  # only white space lies between
                    found.append(at)
                    at += len(t)
            ends.append(len(found))
            missing.append(none)
        return pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.array(found, pa.int32()), mask=pa.array(missing, pa.bool_())
        )

    return F.arrow_udf(starts, "array<int>")


def _placed_in() -> Callable[..., Column]:
    """Arrow function over texts and their tokens with blanks between: every token with its start.

    Without tokens those between white space, see ``_starts_in``. The tokens go as one text because the size of
    a list that is handed over is worked out anew for every row.
    """

    def placed(texts: pa.Array, *tokens: pa.Array) -> pa.Array:
        ends, missing, found, starts = [0], [], [], []
        values = texts.to_numpy(zero_copy_only=False).tolist()
        for text, own in zip(values, tokens[0].to_numpy(zero_copy_only=False).tolist() if tokens else values):
            if text is not None and own is not None:
                own = own.split()
                found += own
                at = 0
                for t in own:
                    at = text.find(t, at)  # only white space lies between
                    starts.append(at)
                    at += len(t)
            ends.append(len(found))
            missing.append(text is None or own is None)
        listed = pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(starts, pa.int32())], ["token", "start"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), listed, mask=pa.array(missing, pa.bool_()))

    return F.arrow_udf(placed, "array<struct<token:string,start:int>>")


def ws_tokens_placed(text: Column) -> Column:
    """The tokens that ``ws_tokens`` gives, each with its start."""
    return _placed_in()(text)


def lib_tokens_placed(text: Column) -> Column:
    """The tokens that ``lib_tokens`` gives, each with its start."""
    return _placed_in()(text, F.array_join(lib_tokens(text), " "))


def starts_in(text: Column, tokens: Column) -> Column:
    """Start offset of every token of ``text``; between tokens there is white space only."""
    return _starts_in()(text, tokens)


def ws_pieces(text: Column) -> Column:
    """Whitespace-separated tokens, each with the whitespace before it."""
    return F.regexp_extract_all(text, F.lit(f"{P.JAVA_WS}*+{P.JAVA_NS_RUN}"), F.lit(0))


def ws_tokens(text: Column) -> Column:
    """Whitespace-separated tokens."""
    return F.regexp_extract_all(text, F.lit(P.JAVA_NS_RUN), F.lit(0))


def ws_token_starts(text: Column) -> Column:
    """Start offsets of the tokens that ``ws_tokens`` gives."""
    return _starts_in()(text)


def lib_pieces(text: Column) -> Column:
    """Tokens with punctuation and English clitics split off, with the whitespace before them."""
    return _lib_matches(text, f"{P.JAVA_WS}*+")


def lib_tokens(text: Column) -> Column:
    """Tokens with punctuation and English clitics split off."""
    return _lib_matches(text, "")


def _lib_matches(text: Column, lead: str) -> Column:
    """The clitic branch looks ahead at every letter, so only texts with an apostrophe take it."""
    clitics = F.regexp_extract_all(text, F.lit(lead + P.LIB_TOKEN), F.lit(0))
    plain = F.regexp_extract_all(text, F.lit(lead + P.PLAIN_TOKEN), F.lit(0))
    return F.when(F.contains(text, F.lit("'")), clitics).otherwise(plain)


def lib_token_starts(text: Column) -> Column:
    """Start offsets of the tokens that ``lib_tokens`` gives."""
    return starts_in(text, lib_tokens(text))


def fix_tokenization(text: Column) -> Column:
    """Undo the spacing mistakes of generation models."""
    # Every step but that of the closing marks needs white space beside its mark, and none puts any there. A
    # search that starts at the marks tells the few texts for which these steps are walked at all.
    single = [marks[0] for marks, *_ in P.JAVA_FIXES if len(marks) == 1]
    closing = next(step for step in P.JAVA_FIXES if len(step[0]) > 1)

    def beside(marks: list[str]) -> str:
        listed = "[" + "".join(re.escape(m) for m in dict.fromkeys(marks)) + "]"
        return f"{listed}(?:{P.JAVA_WS}|(?<={P.JAVA_WS}{listed}))"

    def walked(t: Column) -> Column:
        for marks, pattern, replacement in P.JAVA_FIXES:
            near = beside(marks) if len(marks) == 1 else None
            t = let(t, replace_where(marks, pattern, replacement, near))
        return t

    return let(text, lambda t: F.when(t.rlike(beside(single)), walked(t)).otherwise(replace_where(*closing)(t)))


def replace_where(
    marks: list[str], pattern: str, replacement: str, near: str | None = None
) -> Callable[[Column], Column]:
    """A pattern replacement that first looks for the strings of which the pattern needs one, then for ``near``."""

    def replaced(t: Column) -> Column:
        any_of = functools.reduce(operator.or_, [F.contains(t, F.lit(m)) for m in marks])
        any_of = any_of & t.rlike(near) if near else any_of
        return F.when(any_of, F.regexp_replace(t, pattern, replacement)).otherwise(t)

    return replaced


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(P.WS_CHARS))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(P.WS_CHARS))


def squeeze(text: Column) -> Column:
    """Whitespace runs to one space, ends stripped."""
    return F.array_join(ws_tokens(text), " ")


def normalise_emoji(text: Column, strict: bool = False) -> Column:
    """Remove emoji, then squeeze whitespace."""
    return squeeze(F.regexp_replace(text, P.STRICT_EMOJI if strict else P.EMOJI, ""))


def span_text(text: Column, offset: Column, length: Column) -> Column:
    return F.substring(text, offset + 1, length)


def utf16_offset(text: Column, offset: Column) -> Column:
    """Offset in UTF-16 code units for clients whose strings are UTF-16."""
    before = F.substring(text, F.lit(1), offset)
    astral = F.regexp_replace(before, r"[^\x{10000}-\x{10FFFF}]", "")
    return offset + F.length(astral)


def render_prompt(text: Column, template: str | None) -> Column:
    """Put the text into a template; no template leaves it unchanged."""
    if not template:
        return text
    parts = [F.lit(p) for p in template.split("{{ text }}")]
    out = [parts[0]]
    for part in parts[1:]:
        out += [text, part]
    return F.concat(*out)


def code_name(code: Column, names: dict[int, str]) -> Column:
    """Name of an enum code, null for an unknown code."""
    out = F.lit(None).cast("string")
    for value, name in names.items():
        out = F.when(code == value, name).otherwise(out)
    return out
