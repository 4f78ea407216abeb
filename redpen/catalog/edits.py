"""Catalog: edit extraction, typing and suppression (D, H, J6)."""

from pyspark.sql import functions as F

from redpen.catalog.base import (
    CLEAN, SQL_NS, clean, sql_emoji, sql_fix, sql_lib_tokens, sql_spaced, sql_strip,
    sql_token_rows, sql_ws_tokens, SQL_LIB_TOKEN,
)
from redpen.functions import patterns as P
from redpen.functions import text as X
from redpen.functions.diff import with_hunk
from redpen.operators import edits as E
from redpen.operators import labels, project, suppress
from redpen.plans import damage

IDS = ["doc_id", "sent_idx"]
DAMAGES = ["substituted", "dropped", "inserted"]


def _pairs(spark, sf, more=()):
    """All three single-hunk damages, and more if asked for."""
    return damage.damaged(clean(spark, sf), [*DAMAGES, *more])


def d1_native_edits(spark, sf):
    df = with_hunk(E.with_plain_tokens(_pairs(spark, sf)), "original", "fixed")
    # A hunk is the only edit of its pair, from the shared prefix to the shared suffix.
    df = df.where(F.col("_route") == "hunk").withColumn("_e", F.get("_edits", F.lit(0)))
    return df.select(*IDS, "kind", *[F.col(f"_e.{name}").alias(name) for name in ("i1", "i2", "j1", "j2")])


def d1_routes(spark, sf):
    df = with_hunk(E.with_plain_tokens(_pairs(spark, sf)), "original", "fixed")
    return df.groupBy("kind", F.col("_route").alias("route")).agg(F.count("*").alias("n"))


def d1_all_edits(spark, sf):
    """Every pair, several hunks and the Python branch included: the corrected tokens rebuilt from the edits."""
    df = E.with_plain_edits(_pairs(spark, sf, ["doubled", "thinned"]))

    def taken(e, i):
        """What stays before an edit, and what it puts in."""
        at = F.coalesce(F.get("edits", i - 1)["i2"], F.lit(0))
        same = F.slice("a_tok", at + 1, e["i1"] - at)
        return F.concat(same, F.slice("b_tok", e["j1"] + 1, e["j2"] - e["j1"]))

    last = F.coalesce(F.get("edits", F.size("edits") - 1)["i2"], F.lit(0))
    tail = F.slice("a_tok", last + 1, F.size("a_tok"))
    whole = F.concat(F.flatten(F.transform("edits", taken)), tail)
    # Where the texts agree there are no tokens and no edits.
    rebuilt = F.coalesce(whole, X.ws_tokens(F.col("original")))
    return df.select(*IDS, "kind", F.md5(F.array_join(rebuilt, " ")).alias("digest"))


def plain_path(spark, sf):
    """The plain extractor from pairs to matches, on the pairs whose one hunk is certain."""
    pairs = _pairs(spark, sf).where(F.col("doc_id").isNotNull())
    found = E.explode_matches(E.with_plain_matches(pairs, route="route"))
    return found.where(F.col("route") == "hunk").select(*IDS, "kind", "offset", "length", "replacement", "match_type")


def _given(spark, sf, original, edits):
    """Pairs (damaged, clean) with known opcodes."""
    df = clean(spark, sf)
    df = df.select(*IDS, original(df).alias("original"), F.col("clean").alias("corrected"),
                   edits.cast("array<struct<op:string,i1:int,i2:int,j1:int,j2:int>>").alias("edits"))
    return E.merge_adjacent_ops(E.with_plain_tokens(df, fix=False)).drop("match_idx", "op")


def _op(name, i1, i2, j1, j2):
    return F.struct(F.lit(name).alias("op"), i1.alias("i1"), i2.alias("i2"), j1.alias("j1"), j2.alias("j2"))


def _joined(tokens):
    return F.array_join(tokens, " ")


def d2_replace(spark, sf):
    k = F.col("k")
    return _given(
        spark, sf,
        lambda df: _joined(F.transform("tok", lambda t, i: F.when(i == k, F.concat(t, F.lit("x"))).otherwise(t))),
        F.array(_op("replace", k, k + 1, k, k + 1)),
    )


def d3_insert(spark, sf):
    k = F.col("k")
    return _given(
        spark, sf, lambda df: _joined(F.filter("tok", lambda t, i: i != k)),
        F.array(_op("insert", k, k, k, k + 1)),
    )


def d4_delete(spark, sf):
    k = F.col("k")
    return _given(
        spark, sf,
        lambda df: _joined(F.flatten(F.transform(
            "tok", lambda t, i: F.when(i == k, F.array(F.lit("zzq"), t)).otherwise(F.array(t))))),
        F.array(_op("delete", k, k + 1, k, k)),
    )


def d5_adjacent(spark, sf):
    """Deletion of token 0 and insertion there; then, on the last token, insertion and deletion."""
    n = F.col("n")
    return _given(
        spark, sf, lambda df: F.col("clean"),
        F.array(
            _op("delete", F.lit(0), F.lit(1), F.lit(0), F.lit(0)),
            _op("insert", F.lit(1), F.lit(1), n - 1, n),
            _op("insert", n - 1, n - 1, F.lit(0), F.lit(1)),
            _op("delete", n - 1, n, n, n),
        ),
    )


def d6_min_length(spark, sf):
    df = E.typed_matches(damage.edges(clean(spark, sf), ["colon"]), min_length=4)
    return df.select(*IDS, "offset", "length", "replacement")


def _spans(spark, sf):
    """Known edits with character spans and neighbours, and the anchored match."""
    df = damage.known_edits(clean(spark, sf))
    offset, length = E.token_span_to_chars(
        E.Side(F.col("original"), F.col("t"), F.col("p")), F.col("o_start"), F.col("o_end"))
    return df.withColumn(
        "e",
        F.struct(
            "c_str", offset.alias("span_offset"), length.alias("span_length"),
            F.get("t", F.col("o_start")).alias("next_token"), F.get("p", F.col("o_start")).alias("next_offset"),
            F.get("t", F.col("o_start") - 1).alias("prev_token"),
            F.get("p", F.col("o_start") - 1).alias("prev_offset"),
        ),
    )


def d7_spans(spark, sf):
    return _spans(spark, sf).select(
        *IDS, "kind", F.col("e.span_offset").alias("offset"), F.col("e.span_length").alias("length")
    )


def d8_insertions(spark, sf):
    df = _spans(spark, sf).where(F.col("o_start") == F.col("o_end"))
    return df.select(*IDS, "kind", E.anchor_insertion(F.col("e")).alias("m")).select(*IDS, "kind", "m.*")


def _coded(spark, sf, wanted=None):
    df = damage.known_edits(clean(spark, sf), wanted)
    return df.withColumn(
        "code", labels.edit_code(F.col("o_str"), F.col("c_str"), F.col("o_tok"), F.col("c_tok"))
    )


def d9_codes(spark, sf):
    return _coded(spark, sf).select(*IDS, "kind", "code")


def d9_spelling(spark, sf):
    vocab = labels.vocabulary(
        project.tokens(clean(spark, sf).select(*IDS, F.col("clean").alias("text")), library=True, starts=False)
    )
    df = _coded(spark, sf, ["reversed"]).select(*IDS, "o_str", "c_str", "code")
    # The reversed word is the mistake here.
    df = df.select(*IDS, F.col("c_str").alias("o_str"), F.col("o_str").alias("c_str"), "code")
    return labels.spelling_codes(df, vocab).select(*IDS, "code")


def j6_labels(spark, sf):
    odd = F.when(F.col("kind") == "spaces", "PUNCT").when(F.col("kind") == "swapped", "R:ZZ:Q")
    df = _coded(spark, sf).withColumn("code", F.coalesce(odd, "code"))
    return df.groupBy("code", labels.label_of(F.col("code")).alias("label")).agg(F.count("*").alias("n"))


def d10_typed(spark, sf):
    """Appended marks through the whole typed path."""
    kinds = ["period", "colon", "spaces", "emoji"]
    pairs = damage.edges(clean(spark, sf), kinds)
    return E.typed_matches(pairs, rule_id="edge").drop("match_idx")


def d11_split(spark, sf):
    """Each pair of neighbouring tokens with both marked: two edits, not one."""
    df = clean(spark, sf).withColumns({"t": F.col("tok")})
    hunk = _op("replace", F.lit(0), F.size("t"), F.lit(0), F.size("t"))
    new = F.transform("t", lambda x, i: F.when(i % 3 == 0, x).otherwise(F.concat(x, F.lit("q"))))
    df = df.select(*IDS, "t", new.alias("u"), F.array(hunk).alias("ops"))
    split = E.split_hunks(F.col("t"), F.col("u"), F.col("ops"))
    return df.select(*IDS, F.explode_outer(split).alias("e")).where(F.col("e").isNotNull()).select(*IDS, "e.*")


def _rule(name):
    def query(spark, sf):
        df = damage.known_edits(clean(spark, sf))
        n, s, e, o, c, text = (F.col(x) for x in ("n_tokens", "o_start", "o_end", "o_str", "c_str", "original"))
        hit = {
            "h1_capital_bullet": suppress.capital_bullet(n, s, o, c),
            "h2_trailing_colon": suppress.trailing_colon(n, e, o, c),
            "h3_trailing_period": suppress.trailing_period(n, e, c),
            "h4_colon_for_spaces": suppress.colon_for_spaces(n, e, o, c, text),
            "h5_emoji_only": suppress.emoji_only(o, c),
        }[name]
        return df.where(~hit).select(*IDS, "kind")

    query.__name__ = name
    return query


def h_reasons(spark, sf):
    df = suppress.with_reason(damage.known_edits(clean(spark, sf)))
    return df.groupBy("kind", "suppress_reason").agg(F.count("*").alias("n"))


RULES = {
    "h1_capital_bullet": "n_tokens < 7 AND o_start = 0 AND lower(o_str) = lower(c_str)",
    "h2_trailing_colon": "n_tokens < 5 AND c_str LIKE '%:' AND o_end = n_tokens AND o_str NOT LIKE '%:'",
    "h3_trailing_period": "n_tokens < 10 AND contains(c_str, '.') AND o_end = n_tokens",
    "h4_colon_for_spaces": f"""o_end = n_tokens AND regexp_replace(original, '{P.WS}+$', '') <> original
      AND c_str LIKE '%:' AND {sql_strip('o_str')} = ''""",
    "h5_emoji_only": f"{sql_emoji('o_str')} = {sql_emoji('c_str')}",
}

QUERIES = {
    f.__name__: f
    for f in (
        d1_native_edits, d1_routes, plain_path, d1_all_edits, d2_replace, d3_insert, d4_delete, d5_adjacent,
        d6_min_length, d7_spans, d8_insertions, d9_codes, d9_spelling, d10_typed, d11_split, j6_labels,
        *[_rule(name) for name in RULES], h_reasons,
    )
}

# --- SQL -------------------------------------------------------------------------

_PAIRS = CLEAN + f""",
pairs AS (
  SELECT doc_id, sent_idx, 'substituted' AS kind, {sql_spaced('clean')} AS corrected,
    array_to_string(list_transform(tok, lambda t, i: CASE WHEN i - 1 = k THEN reverse(t) ELSE t END), ' ') AS original FROM clean
  UNION ALL SELECT doc_id, sent_idx, 'dropped', {sql_spaced('clean')},
    array_to_string(list_filter(tok, lambda t, i: i - 1 <> k), ' ') FROM clean
  UNION ALL SELECT doc_id, sent_idx, 'inserted', {sql_spaced('clean')},
    array_to_string(list_transform(tok, lambda t, i: CASE WHEN i - 1 = k THEN 'zzq ' || t ELSE t END), ' ') FROM clean)"""


def _prefix(a: str, b: str) -> str:
    zipped = f"list_transform(list_zip({a}, {b}), lambda z: z[1] IS NOT DISTINCT FROM z[2])"
    return f"coalesce(nullif(list_position({zipped}, false), 0) - 1, len({a}))"


def _stretch_sql(a: str, b: str) -> str:
    """Longest stretch in a of tokens repeated in a or b, from columns ra and rb."""
    return f"""coalesce(list_max(list_transform(string_split(array_to_string(list_transform({a}, lambda t:
      CASE WHEN len(list_filter({a}, lambda y: y = t)) > 1 OR len(list_filter({b}, lambda y: y = t)) > 1
      THEN '1' ELSE '0' END), ''), '0'), lambda s: length(s))), 0)"""


_HUNK = _PAIRS + f""",
two AS (SELECT doc_id, sent_idx, kind, {sql_ws_tokens('original')} AS a, {sql_ws_tokens(sql_fix('corrected'))} AS b FROM pairs),
pre AS (SELECT *, len(a) AS na, len(b) AS nb, {_prefix('a', 'b')} AS p,
        {_prefix('list_reverse(a)', 'list_reverse(b)')} AS r FROM two),
suf AS (SELECT *, least(r, least(na, nb) - p) AS s FROM pre),
pl AS (SELECT *, a <> b AND greatest(na, nb) < 200 AND NOT list_has_any(a[p + 1:na - s], b[p + 1:nb - s])
         AND CASE WHEN p = 0 THEN true WHEN na = p + s THEN b[nb - s] <> a[p]
                  WHEN nb = p + s THEN a[na - s] <> b[p] ELSE true END AS plain FROM suf),
st AS (SELECT *, CASE WHEN plain THEN {_stretch_sql('a', 'b')} END AS whole,
  CASE WHEN plain THEN CASE WHEN p >= s THEN a[p + 1:] ELSE a[:na - s] END END AS pa,
  CASE WHEN plain THEN CASE WHEN p >= s THEN b[p + 1:] ELSE b[:nb - s] END END AS pb FROM pl),
routed AS (SELECT *, CASE WHEN a = b THEN 'equal' WHEN na = 0 OR nb = 0 THEN 'hunk'
  WHEN plain AND (greatest(p, s) = 0 OR greatest(p, s) > whole)
    AND (least(p, s) = 0 OR least(p, s) > {_stretch_sql('pa', 'pb')}) THEN 'hunk' ELSE 'diff' END AS route FROM st)"""

_KNOWN = CLEAN + f""",
lib AS (SELECT doc_id, sent_idx, clean, {sql_lib_tokens('clean')} AS t FROM clean),
libk AS (SELECT *, len(t) AS n_tokens, (doc_id * 31 + sent_idx * 7) % len(t) AS k FROM lib),
known AS (
  SELECT doc_id, sent_idx, n_tokens, x.kind AS kind, x.original AS original, x.o_start AS o_start, x.o_end AS o_end,
         array_to_string(x.o_tok, ' ') AS o_str, array_to_string(x.c_tok, ' ') AS c_str, x.o_tok AS o_tok, x.c_tok AS c_tok
  FROM (SELECT doc_id, sent_idx, n_tokens, unnest([
    {{'kind': 'case', 'original': clean, 'o_start': CAST(0 AS BIGINT), 'o_end': CAST(1 AS BIGINT), 'o_tok': [t[1]],
      'c_tok': [upper(substring(t[1], 1, 1)) || substring(t[1], 2)]}},
    {{'kind': 'period', 'original': clean, 'o_start': n_tokens, 'o_end': n_tokens, 'o_tok': [], 'c_tok': ['.']}},
    {{'kind': 'colon', 'original': clean, 'o_start': n_tokens, 'o_end': n_tokens, 'o_tok': [], 'c_tok': [':']}},
    {{'kind': 'spaces', 'original': clean || '  ', 'o_start': n_tokens, 'o_end': n_tokens, 'o_tok': [], 'c_tok': [':']}},
    {{'kind': 'emoji', 'original': clean, 'o_start': n_tokens, 'o_end': n_tokens, 'o_tok': [], 'c_tok': ['😀']}},
    {{'kind': 'reversed', 'original': clean, 'o_start': k, 'o_end': k + 1, 'o_tok': [t[k + 1]], 'c_tok': [reverse(t[k + 1])]}},
    {{'kind': 'missing', 'original': clean, 'o_start': k, 'o_end': k, 'o_tok': [], 'c_tok': [t[k + 1]]}},
    {{'kind': 'unneeded', 'original': clean, 'o_start': k, 'o_end': k + 1, 'o_tok': [t[k + 1]], 'c_tok': []}},
    {{'kind': 'swapped', 'original': clean, 'o_start': k, 'o_end': least(k + 2, n_tokens), 'o_tok': t[k + 1:k + 2],
      'c_tok': list_reverse(t[k + 1:k + 2])}}]) AS x FROM libk))"""

_LIB_ROWS = sql_token_rows("ltoks", "clean", "clean", SQL_LIB_TOKEN)
_SPANS = f"""{_KNOWN}, {_LIB_ROWS},
spans AS (SELECT e.*, f.start AS next_offset, f.token AS next_token, b.start AS prev_offset, b.token AS prev_token,
    CASE WHEN o_start = o_end THEN coalesce(f.start, b.start + length(b.token), 0) ELSE f.start END AS span_offset,
    CASE WHEN o_start = o_end THEN 0 ELSE l.start + length(l.token) - f.start END AS span_length
  FROM known e
  LEFT JOIN ltoks f ON e.doc_id = f.doc_id AND e.sent_idx = f.sent_idx AND f.pos = e.o_start
  LEFT JOIN ltoks b ON e.doc_id = b.doc_id AND e.sent_idx = b.sent_idx AND b.pos = e.o_start - 1
  LEFT JOIN ltoks l ON e.doc_id = l.doc_id AND e.sent_idx = l.sent_idx AND l.pos = e.o_end - 1)"""


def _in_class(words: list[str]) -> str:
    listed = ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    return f"((o_str = '' OR lower(o_str) IN ({listed})) AND (c_str = '' OR lower(c_str) IN ({listed})))"


def _both(pattern: str) -> str:
    return f"((o_str = '' OR regexp_matches(o_str, '{pattern}')) AND (c_str = '' OR regexp_matches(c_str, '{pattern}')))"


_CODE = f"""CASE WHEN o_str = '' THEN 'M' WHEN c_str = '' THEN 'U' ELSE 'R' END || ':' || CASE
  WHEN regexp_replace(lower(o_str), '{P.WS}+', '', 'g') = regexp_replace(lower(c_str), '{P.WS}+', '', 'g') THEN 'ORTH'
  WHEN len(o_tok) > 1 AND list_sort(o_tok) = list_sort(c_tok) THEN 'WO'
  WHEN {_both('^[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+$')} THEN 'PUNCT'
  WHEN {_both('^' + chr(92) + 'p{N}[' + chr(92) + 'p{N}.,]*$')} THEN 'NUM'
  {' '.join(f"WHEN {_in_class(words)} THEN '{name}'" for name, words in P.CLOSED_CLASSES.items())}
  ELSE 'OTHER' END"""

_LABELS = "CASE bare " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.ERROR_LABELS.items()) + " ELSE bare END"

# Rows of (doc, sentence, original tokens) with neighbours, for the given-opcode queries.
_WS_ROWS = sql_token_rows("wtoks", "dmg", "original", SQL_NS + "+")


def _given_sql(original: str, body: str) -> str:
    return f"""WITH {CLEAN}, dmg AS (SELECT doc_id, sent_idx, tok, n AS nc, k, clean, {original} AS original FROM clean),
      {_WS_ROWS} {body}"""


ORACLES = {
    "d1_native_edits": f"""WITH {_HUNK} SELECT doc_id, sent_idx, kind, p AS i1, na - s AS i2, p AS j1, nb - s AS j2
      FROM routed WHERE route = 'hunk'""",
    "d1_routes": f"WITH {_HUNK} SELECT kind, route, count(*) AS n FROM routed GROUP BY ALL",
    "d1_all_edits": f"""WITH {CLEAN} SELECT doc_id, sent_idx,
      unnest(['substituted', 'dropped', 'inserted', 'doubled', 'thinned']) AS kind,
      md5(array_to_string({sql_ws_tokens(sql_fix(sql_spaced('clean')))}, ' ')) AS digest FROM clean""",
    "plain_path": f"""WITH {_HUNK},
      h AS (SELECT *, p AS i1, na - s AS i2, array_to_string(b[p + 1:nb - s], ' ') AS new, nb - s > p AS adds FROM routed WHERE route = 'hunk' AND na > 0),
      c AS (SELECT *, CASE WHEN adds AND i2 > i1 THEN 'replace' WHEN adds AND i1 < na THEN 'before' WHEN adds THEN 'after'
                           WHEN i1 > 0 THEN 'previous' ELSE 'next' END AS way FROM h),
      f AS (SELECT *, CASE way WHEN 'after' THEN na - 1 WHEN 'previous' THEN i1 - 1 ELSE i1 END AS lo,
              CASE way WHEN 'replace' THEN i2 WHEN 'before' THEN i1 + 1 WHEN 'after' THEN na WHEN 'previous' THEN i2 ELSE i2 + 1 END AS hi FROM c)
      SELECT doc_id, sent_idx, kind, CASE WHEN lo = 0 THEN 0 ELSE length(array_to_string(a[1:lo], ' ')) + 1 END AS "offset",
        length(array_to_string(a[lo + 1:hi], ' ')) AS length,
        CASE way WHEN 'replace' THEN new WHEN 'before' THEN new || ' ' || a[i1 + 1] WHEN 'after' THEN a[na] || ' ' || new
                 WHEN 'previous' THEN a[i1] ELSE a[i2 + 1] END AS replacement,
        CASE WHEN way = 'replace' THEN CAST(1 AS BIGINT) END AS match_type FROM f""",
    "d2_replace": _given_sql(
        "array_to_string(list_transform(tok, lambda t, i: CASE WHEN i - 1 = k THEN t || 'x' ELSE t END), ' ')",
        """SELECT d.doc_id, d.sent_idx, start AS "offset", length(token) AS length, tok[k + 1] AS replacement,
           tok[k + 1] AS message, CAST(1 AS BIGINT) AS match_type
           FROM dmg d JOIN wtoks w ON d.doc_id = w.doc_id AND d.sent_idx = w.sent_idx AND pos = k"""),
    "d3_insert": _given_sql(
        "array_to_string(list_filter(tok, lambda t, i: i - 1 <> k), ' ')",
        """SELECT d.doc_id, d.sent_idx, start AS "offset", length(token) AS length,
           CASE WHEN pos = k THEN tok[k + 1] || ' ' || token ELSE token || ' ' || tok[k + 1] END AS replacement,
           CASE WHEN pos = k THEN tok[k + 1] || ' ' || token ELSE token || ' ' || tok[k + 1] END AS message,
           CAST(NULL AS BIGINT) AS match_type
           FROM dmg d JOIN wtoks w ON d.doc_id = w.doc_id AND d.sent_idx = w.sent_idx AND pos = least(k, w.n - 1)"""),
    "d4_delete": _given_sql(
        "array_to_string(list_transform(tok, lambda t, i: CASE WHEN i - 1 = k THEN 'zzq ' || t ELSE t END), ' ')",
        """SELECT d.doc_id, d.sent_idx, CASE WHEN k > 0 THEN b.start ELSE w.start END AS "offset",
           CASE WHEN k > 0 THEN w.start + 3 - b.start ELSE f.start + length(f.token) - w.start END AS length,
           CASE WHEN k > 0 THEN b.token ELSE f.token END AS replacement,
           CASE WHEN k > 0 THEN b.token ELSE f.token END AS message, CAST(NULL AS BIGINT) AS match_type
           FROM dmg d JOIN wtoks w ON d.doc_id = w.doc_id AND d.sent_idx = w.sent_idx AND w.pos = k
           LEFT JOIN wtoks b ON d.doc_id = b.doc_id AND d.sent_idx = b.sent_idx AND b.pos = k - 1
           LEFT JOIN wtoks f ON d.doc_id = f.doc_id AND d.sent_idx = f.sent_idx AND f.pos = k + 1"""),
    "d5_adjacent": _given_sql(
        "clean",
        """SELECT d.doc_id, d.sent_idx, start AS "offset", length(token) AS length,
             CASE w FROM_FIRST WHEN true THEN 1 END FROM dmg d""".replace("CASE w FROM_FIRST WHEN true THEN 1 END", "1")),
    "d6_min_length": f"""WITH {CLEAN}, {_LIB_ROWS} SELECT doc_id, sent_idx, start AS "offset", length(token) AS length,
      token || ' :' AS replacement FROM ltoks WHERE pos = n - 1 AND n >= 5 AND length(token) >= 4""",
    "d7_spans": f"""WITH {_SPANS} SELECT doc_id, sent_idx, kind, CAST(span_offset AS BIGINT) AS "offset",
      CAST(span_length AS BIGINT) AS length FROM spans""",
    "d8_insertions": f"""WITH {_SPANS} SELECT doc_id, sent_idx, kind,
      coalesce(next_offset, prev_offset, 0) AS "offset", coalesce(length(next_token), length(prev_token), 0) AS length,
      coalesce(c_str || ' ' || next_token, prev_token || ' ' || c_str, c_str) AS replacement
      FROM spans WHERE o_start = o_end""",
    "d9_codes": f"WITH {_KNOWN} SELECT doc_id, sent_idx, kind, {_CODE} AS code FROM known",
    "d9_spelling": f"""WITH {_KNOWN}, {_LIB_ROWS}, vocab AS (SELECT lower(token) AS token, count(*) AS n FROM ltoks GROUP BY 1),
      c AS (SELECT doc_id, sent_idx, lower(c_str) AS o, lower(o_str) AS w, {_CODE} AS code FROM known WHERE kind = 'reversed')
      SELECT doc_id, sent_idx, CASE WHEN code = 'R:OTHER' AND regexp_matches(o, '^{P.WORD}+$')
        AND regexp_matches(w, '^{P.WORD}+$') AND coalesce(v1.n, 0) <= 1 AND v2.n >= 2 AND spark_levenshtein(o, w) <= 2
        THEN 'R:SPELL' ELSE code END AS code
      FROM c LEFT JOIN vocab v1 ON c.o = v1.token LEFT JOIN vocab v2 ON c.w = v2.token""",
    "d10_typed": f"""WITH {CLEAN}, {_LIB_ROWS}, last AS (SELECT * FROM ltoks WHERE pos = n - 1),
      rows AS (SELECT *, unnest([{{'kind': 'period', 'm': '.'}}, {{'kind': 'colon', 'm': ':'}}, {{'kind': 'spaces', 'm': ':'}}]) AS x FROM last)
      SELECT doc_id, sent_idx, x.kind AS kind, start AS "offset", length(token) AS length, token || ' ' || x.m AS replacement,
        'Punctuation' AS description, 'Punctuation' AS message, 'edge' AS rule_id, CAST(2 AS BIGINT) AS match_type
      FROM rows WHERE (x.kind = 'period' AND n >= 10) OR (x.kind = 'colon' AND n >= 5)""",
    "d11_split": f"""WITH {CLEAN} SELECT doc_id, sent_idx, 'replace' AS op, i AS i1, i + 1 AS i2, i AS j1, i + 1 AS j2
      FROM (SELECT doc_id, sent_idx, n, unnest(range(n)) AS i FROM clean) WHERE i % 3 <> 0 UNION ALL
      SELECT doc_id, sent_idx, 'replace', CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT)
      FROM clean WHERE n = 1""",
    "j6_labels": f"""WITH {_KNOWN}, c AS (SELECT CASE kind WHEN 'spaces' THEN 'PUNCT' WHEN 'swapped' THEN 'R:ZZ:Q' ELSE {_CODE} END AS code FROM known),
      b AS (SELECT code, CASE WHEN contains(code, ':') THEN regexp_replace(code, '^[^:]*:', '') ELSE 'OTHER' END AS bare FROM c)
      SELECT code, {_LABELS} AS label, count(*) AS n FROM b GROUP BY ALL""",
    **{
        name: f"WITH {_KNOWN} SELECT doc_id, sent_idx, kind FROM known WHERE NOT ({rule})"
        for name, rule in RULES.items()
    },
    "h_reasons": f"""WITH {_KNOWN} SELECT kind, CASE {' '.join(f"WHEN {rule} THEN '{name[3:]}'" for name, rule in RULES.items())} END
      AS suppress_reason, count(*) AS n FROM known GROUP BY ALL""",
}

# Deletion and insertion at token 0 make one match; insertion and deletion at the
# last token another. In a one-token sentence the four operations touch in turn.
ORACLES["d5_adjacent"] = _given_sql(
    "clean",
    """SELECT d.doc_id, d.sent_idx, start AS "offset", length(token) AS length, r AS replacement, r AS message,
         CAST(NULL AS BIGINT) AS match_type
       FROM (SELECT *, unnest([0, nc - 1]) AS at, unnest([tok[nc], tok[1] || ' ' || tok[nc]]) AS r FROM dmg) d
       JOIN wtoks w ON d.doc_id = w.doc_id AND d.sent_idx = w.sent_idx AND w.pos = d.at""",
)
# DuckDB counts bytes; map the accented letters of the corpus to single bytes first.
_ASCII = "translate({}, 'áàâäéèêëíìîïñóòôöúùûüçßœæ', 'ABCDEFGHIJKLMNOPQRSTUVWX')"
ORACLES["d9_spelling"] = ORACLES["d9_spelling"].replace(
    "spark_levenshtein(o, w)", f"levenshtein({_ASCII.format('o')}, {_ASCII.format('w')})"
)
