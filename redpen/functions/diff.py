"""Token diff: from two token arrays to edit operations.

The result is defined by the standard library's ``SequenceMatcher``. One Arrow function
trims what both sides share, tells the pairs whose result is provably one hunk, and
runs the matcher on the others only.
"""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redpen.functions.text import hold

EDIT_DDL = "array<struct<op:string,i1:int,i2:int,j1:int,j2:int>>"


def differ() -> Callable[[list, list], tuple]:
    """Function of two token lists: shared prefix and suffix, route, and edits (op, i1, i2, j1, j2).

    Built in a closure so that it is sent by value and executors need no copy of
    this package.
    """
    from difflib import SequenceMatcher

    def repeated(tokens: list) -> set:
        """Distinct tokens that occur more than once."""
        if len(set(tokens)) == len(tokens):
            return set()
        seen = set()
        again = {t for t in tokens if t in seen or seen.add(t)}
        again.discard(None)
        return again

    def stretch(tokens: list, members: set) -> int:
        """Longest stretch of tokens that are members."""
        best = run = 0
        for t in tokens if members else ():
            if t in members:
                run += 1
                if run > best:
                    best = run
            else:
                run = 0
        return best

    def proven(x: list, y: list, p: int, s: int) -> bool:
        """Whether the trimmed hunk is the matcher's result, see ``with_hunk``."""
        na, nb = len(x), len(y)
        if max(na, nb) >= 200:
            return False
        # With one middle empty, the suffix must not also fit further left.
        if p and (y[nb - s - 1] == x[p - 1] if na == p + s else nb == p + s and x[na - s - 1] == y[p - 1]):
            return False
        mid_a, mid_b = x[p:na - s], y[p:nb - s]
        if mid_a and mid_b and (None in mid_a or None in mid_b or not set(mid_a).isdisjoint(mid_b)):
            return False
        long, short = max(p, s), min(p, s)
        if not long:
            return True
        members = repeated(x)
        # What only y repeats, its middle has: all else stands in x as well.
        members |= {t for t in mid_b if t is not None and y.count(t) > 1} if len(mid_b) < 8 else repeated(y)
        few = sum(map(members.__contains__, x)) if members else 0  # no stretch is longer
        if long <= few and long <= stretch(x, members):
            return False
        # The piece that is left after the longer anchor; it repeats no more than the whole.
        if not short or short > few:
            return True
        left = (x[p:], y[p:]) if p >= s else (x[:na - s], y[:nb - s])
        return short > stretch(left[0], repeated(left[0]) | repeated(left[1]))

    def opcodes(x: list, y: list) -> list:
        """Edits of ``SequenceMatcher``, which is asked only where they are not certain.

        A token that both sides have once can only meet its like, so a block with such a token is
        found by looking there. All other blocks are made of repeated tokens, and if the longest found
        beats the longest stretch of these, the matcher takes it. From 200 tokens on, the matcher leaves popular
        tokens out of the comparison of lengths and adds them afterwards.
        """
        na, nb = len(x), len(y)
        members = repeated(x) | repeated(y) | {None}
        place = {t: j for j, t in enumerate(y)}
        popular = set()
        if nb >= 200:
            most, counts = nb // 100 + 1, {}
            for t in y:
                counts[t] = counts.get(t, 0) + 1
            popular = {t for t, n in counts.items() if n > most}
        rare = members - popular
        matcher, blocks, open_ = None, [], [(0, na, 0, nb)]
        while open_:
            alo, ahi, blo, bhi = open_.pop()
            if alo == ahi or blo == bhi:
                continue
            size = bound = run = 0
            i = alo
            while i < ahi:
                t = x[i]
                if t in members:
                    run = run + 1 if t in rare else 0
                    if run > bound:
                        bound = run
                    i += 1
                    continue
                run = 0
                j = place.get(t, -1)
                if not blo <= j < bhi:
                    i += 1
                    continue
                first, last, d = i, i + 1, j - i
                while first > alo and first + d > blo and (u := x[first - 1]) == y[first - 1 + d] and u not in popular:
                    first -= 1
                # Repeated tokens inside the block are a stretch for other blocks as well.
                while last < ahi and last + d < bhi and (u := x[last]) == y[last + d] and u not in popular:
                    run = run + 1 if u in rare else 0
                    if run > bound:
                        bound = run
                    last += 1
                if last - first > size:
                    at, to, size = first, first + d, last - first
                i = last
            if size <= bound:
                if not bound and not popular:
                    continue
                matcher = matcher or SequenceMatcher(None, x, y)
                at, to, size = matcher.find_longest_match(alo, ahi, blo, bhi)
                if not size:
                    continue
            elif popular:
                end = at + size
                while at > alo and to > blo and x[at - 1] == y[to - 1]:
                    at, to = at - 1, to - 1
                while end < ahi and end - at + to < bhi and x[end] == y[end - at + to]:
                    end += 1
                size = end - at
            blocks.append((at, to, size))
            open_ += [(alo, at, blo, to), (at + size, ahi, to + size, bhi)]
        blocks.sort()
        edits, i, j = [], 0, 0
        for at, to, size in [*blocks, (na, nb, 0)]:
            if i < at or j < to:
                edits.append(("replace" if i < at and j < to else "delete" if i < at else "insert", i, at, j, to))
            i, j = at + size, to + size
        return edits

    def compared(x: list, y: list) -> tuple:
        if x == y:
            return len(x), 0, "equal", ()
        na, nb = len(x), len(y)
        shorter = min(na, nb)
        p = s = 0
        for t, u in zip(x, y):
            if t != u:
                break
            p += 1
        while s < shorter - p and x[na - 1 - s] == y[nb - 1 - s]:
            s += 1
        if not shorter or proven(x, y, p, s):
            return p, s, "hunk", (("insert" if na - s == p else "delete" if nb - s == p else "replace", p, na - s, p, nb - s),)
        return p, s, "diff", opcodes(x, y)

    return compared


def _compared() -> Callable[[Column, Column], Column]:
    """Arrow function over pairs of token arrays or texts: shared ends, route and edits of each."""
    compared = differ()
    names = ("i1", "i2", "j1", "j2")
    edit = T.StructType([T.StructField("op", T.StringType())])
    result = T.StructType()
    for name in names:
        edit = edit.add(name, T.IntegerType())
    for name in ("p", "s"):
        result = result.add(name, T.IntegerType())
    result = result.add("route", T.StringType()).add("edits", T.ArrayType(edit))

    def rows(tokens: pa.Array) -> list:
        """Token lists of an array of lists or of texts, null where there is none.

        White space of ``str.split`` is that of ``patterns.WS``.
        """
        if pa.types.is_string(tokens.type) or pa.types.is_large_string(tokens.type):
            return [t if t is None else t.split() for t in tokens.to_numpy(zero_copy_only=False).tolist()]
        values = tokens.values.to_numpy(zero_copy_only=False).tolist()
        ends = tokens.offsets.to_pylist()
        valid = tokens.is_valid().to_numpy(zero_copy_only=False).tolist()
        return [values[i:j] if ok else None for ok, i, j in zip(valid, ends, ends[1:])]

    def compare(a: pa.Array, b: pa.Array) -> pa.Array:
        prefixes, suffixes, routes, ends, edits = [], [], [], [0], []
        for x, y in zip(rows(a), rows(b)):
            p, s, route, found = (None, None, "equal", ()) if x is None or y is None else compared(x, y)
            prefixes.append(p)
            suffixes.append(s)
            routes.append(route)
            edits += found
            ends.append(len(edits))
        kinds = [pa.string(), *[pa.int32()] * 4]
        fields = [pa.array([e[k] for e in edits], kind) for k, kind in enumerate(kinds)]
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["op", *names]))
        return pa.StructArray.from_arrays(
            [pa.array(prefixes, pa.int32()), pa.array(suffixes, pa.int32()), pa.array(routes, pa.string()), listed],
            ["p", "s", "route", "edits"],
        )

    return F.arrow_udf(compare, result)


def with_hunk(df: DataFrame, a: str, b: str) -> DataFrame:
    """Add shared prefix and suffix, the route (``equal``, ``hunk`` or ``diff``) and the edits of each pair.

    ``a`` and ``b`` are token arrays, or texts, which are then compared by their whitespace
    tokens and cost far less to hand over. Nulls count as equal.

    ``hunk`` is proven to be the exact diff. The middles share no token, so any
    other alignment of the two sides is made of repeated tokens. If the longer of
    the shared prefix and suffix beats the longest stretch of repeated tokens, the
    matcher takes it first; what is left is the middle with the shorter one, and
    the same holds there with the tokens repeated in that piece. Below 200 tokens
    the popularity rule of the matcher is off.
    """
    found = df.withColumn("_found", _compared()(F.col(a), F.col(b)))
    added = {"_p": "p", "_s": "s", "_route": "route", "_edits": "edits"}
    # Held: a filter on the route would be moved below the function and run it a second time.
    return hold(found, {name: F.col(f"_found.{field}") for name, field in added.items()}).drop("_found")


def with_edits(df: DataFrame, a: str, b: str, out: str = "edits", route: str | None = None) -> DataFrame:
    """Add the edit operations between ``a`` and ``b``, see ``with_hunk``, and on request the route."""
    added = {out: F.col("_edits")} | ({route: F.col("_route")} if route else {})
    return with_hunk(df, a, b).withColumns(added).drop("_p", "_s", "_route", "_edits")
