"""Catalog: applying matches, profiles, agreement, readings, the breaker, bounded and streamed reuse (E, D9, A3, J5, T)."""

from pyspark.sql import functions as F

from redpen.catalog.base import CLEAN, SENTS, clean, documents, r6, sentences, sql_fix, sql_spaced, sql_ws_tokens, table
from redpen.catalog.edits import _CODE, _KNOWN, _LABELS, _coded, _pairs
from redpen.catalog.flags import FLAGS, WORDS, flagged, flagged_rows
from redpen.catalog.service import _CORRECTED, _rewritten, calls
from redpen.functions import text as X
from redpen.operators import apply, fanout, labels, runs
from redpen.operators import edits as E
from redpen.sources import sinks, streams
from redpen.streaming import jobs

IDS = ["doc_id", "sent_idx"]


def e1_apply(spark, sf):
    """Damaged sentences: their matches put in give the corrected tokens."""
    df = apply.apply_matches(E.with_plain_matches(_pairs(spark, sf)), "original")
    return df.select(*IDS, "kind", F.md5(F.array_join(X.ws_tokens(F.col("applied")), " ")).alias("digest"))


def e1_overlaps(spark, sf):
    """Matches of three correctors, overlaps among them, put into all sentences."""
    df = apply.apply_match_rows(sentences(spark, sf).select(*IDS, "text"), flagged_rows(sentences(spark, sf)), IDS)
    return df.select(*IDS, F.md5("applied").alias("digest"), "n_applied")


def e2_profile(spark, sf):
    """Labels by language and source with all subtotals; a fifth of the documents has no source."""
    where = documents(spark, sf).select("doc_id", "lang", F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"))
    coded = _coded(spark, sf).select("doc_id", labels.label_of(F.col("code")).alias("label"))
    return runs.error_profile(coded.join(where, "doc_id"), ["label", "lang", "source"])


def e4_agreement(spark, sf):
    df = runs.corrector_agreement(flagged(sentences(spark, sf)), len(WORDS))
    return df.withColumns({"expected": r6("expected"), "agreement": r6("agreement")})


CAPACITY = 3000


def j5_bounded(spark, sf):
    """What stays after a refill: the latest used texts, known ones and new ones."""
    base = sentences(spark, sf).select(*IDS, "text", (F.col("doc_id") * 7 + F.col("sent_idx") % 5).alias("asked"))
    known = base.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    cache = _rewritten(known.groupBy("text").agg(F.max(F.col("asked") * 3).alias("used")))
    asked = base.where(F.col("doc_id") % 3 != 0)
    _, kept = fanout.reuse_bounded(asked, cache, _rewritten, CAPACITY)
    return kept.select(F.md5("text").alias("text"), "used", F.md5("corrected").alias("digest"))


def t2_reuse(spark, sf):
    """A stream of sentences in several batches: each gets its result, each text is computed once."""
    asked, known, out = (sinks.shared_folder(spark, p) for p in ("asked", "known", "results"))
    sentences(spark, sf).select(*IDS, "text").repartition(3, "doc_id").write.parquet(asked)
    rows = spark.read.parquet(asked)
    stream = streams.stream_table(spark, asked, rows.schema, 1)
    computed = _rewritten(rows.select("text")).schema
    jobs.reuse_in_batches(stream, _rewritten, computed, out, known, out + "-state")
    results = spark.read.parquet(out).select(*IDS, F.md5("corrected").alias("digest"))
    stored = jobs.known_results(spark, known, computed).groupBy("text").agg(F.count("*").alias("n"))
    # Every text must be stored once: a second time would show up as a larger count.
    return results.withColumn("most_stored", stored.agg(F.max("n").alias("n")).scalar())


DELAY_DAYS = 3650


def t1_match_rows(spark, sf):
    """Match rows of three correctors that arrive in any order, merged when the watermark has passed."""
    folder, out = sinks.shared_folder(spark, "arrived"), sinks.shared_folder(spark, "merged")
    rows = flagged_rows(sentences(spark, sf)).withColumn("ts", F.timestamp_seconds(F.lit(1_000_000_000) + F.col("doc_id")))
    rows.repartition(6, "corrector_idx", "match_idx").write.parquet(folder)
    last = rows.agg(F.max("ts").alias("ts")).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "ts"],
        (F.col("ts") + F.expr(f"interval {2 * DELAY_DAYS} days")).alias("ts"),
    )
    last.select(*rows.columns).write.mode("append").parquet(folder)  # moves the watermark past all others
    stream = streams.stream_table(spark, folder, rows.schema, 3)
    jobs.run_available(jobs.merge_match_stream(stream, IDS, "ts", f"{DELAY_DAYS} days"), out, out + "-state")
    merged = spark.read.parquet(out).where(F.col("doc_id").isNotNull())
    return E.explode_matches(merged.select(*IDS, "matches"), "matches", "rank")


BREAKER = {"window_s": 86_400, "min_calls": 5, "threshold": 30.0, "down_ms": 43_200_000}


def a3_breaker(spark, sf):
    log = calls(table(spark, sf, "events"))
    rule = F.concat(F.lit("rule"), F.pmod(F.col("call_id"), F.lit(40)))
    return runs.breaker_states(log.withColumn("rule_id", rule), **BREAKER)


def _readings(tokens):
    """Readings by length and ending: a stand-in for a tagger that both Spark and SQL can compute."""
    def one(t):
        lemma = F.regexp_replace(F.lower(t), "(ing|ed|s)$", "")
        ending = F.regexp_extract(F.lower(t), "(ing|ed|s)$", 1)
        pos = F.element_at(F.array(*[F.lit(p) for p in _POS]), F.length(lemma) % 5 + 1)
        form = F.coalesce(*[F.when((pos == p) & (ending == e), F.lit(f)) for (p, e), f in _FORMS.items()], pos)
        return F.struct(pos.alias("pos"), form.alias("form"), lemma.alias("lemma"))

    return F.transform(tokens, one).cast(labels.READING)


_POS = ["VERB", "NOUN", "ADJ", "ADV", "X"]
_FORMS = {
    ("VERB", ""): "VB", ("VERB", "s"): "VBZ", ("VERB", "ed"): "VBD", ("VERB", "ing"): "VBG", ("NOUN", ""): "NN",
    ("NOUN", "s"): "NNS", ("NOUN", "ed"): "POS", ("ADJ", ""): "JJ", ("ADJ", "ed"): "JJR", ("ADJ", "s"): "JJS",
}
_ENDINGS = ["s", "ed", "ing", "s"]


def d9_pos(spark, sf):
    """Known edits, and sentences with one inflected token, typed by the readings of their tokens."""
    known = _coded(spark, sf).select(*IDS, "kind", "code", "o_tok", "c_tok")
    base = clean(spark, sf)
    token = F.get("tok", F.col("k"))
    ending = F.element_at(F.array(*[F.lit(e) for e in _ENDINGS]), (F.col("doc_id") + F.col("sent_idx")).cast("int") % 4 + 1)
    bent = base.where(token.rlike(r"^\p{L}+$")).select(
        *IDS, F.lit("bent").alias("kind"), F.array(F.concat(token, ending)).alias("o_tok"), F.array(token).alias("c_tok"))
    bent = bent.withColumn("code", labels.edit_code(F.get("o_tok", F.lit(0)), F.get("c_tok", F.lit(0)), F.col("o_tok"), F.col("c_tok")))
    df = X.hold(known.unionByName(bent), {"o_read": _readings("o_tok"), "c_read": _readings("c_tok")})
    return df.select(*IDS, "kind", labels.pos_code(F.col("code"), F.col("o_read"), F.col("c_read")).alias("code"))


QUERIES = {
    f.__name__: f
    for f in (
        e1_apply, e1_overlaps, e2_profile, e4_agreement, j5_bounded, t2_reuse, t1_match_rows, a3_breaker, d9_pos,
    )
}

# --- SQL -------------------------------------------------------------------------


def _ending(t: str) -> str:
    return f"regexp_extract(lower({t}), '(ing|ed|s)$', 1)"


def _sql_reading(t: str) -> str:
    lemma = f"regexp_replace(lower({t}), '(ing|ed|s)$', '')"
    pos = f"[{', '.join(repr(p) for p in _POS)}][length({lemma}) % 5 + 1]"
    forms = " ".join(f"WHEN '{p}' || ':' || '{e}' THEN '{f}'" for (p, e), f in _FORMS.items())
    return f"{{'pos': {pos}, 'form': CASE {pos} || ':' || {_ending(t)} {forms} ELSE {pos} END, 'lemma': {lemma}}}"


_READ = ", ".join(f"list_transform({side}_tok, lambda t: {_sql_reading('t')}) AS {side}" for side in "oc")
_SAME = "len(o) = 1 AND len(c) = 1 AND o[1].lemma = c[1].lemma"


def _both_pos(*kinds: str) -> str:
    listed = ", ".join(f"'{k}'" for k in kinds)
    return f"o[1].pos IN ({listed}) AND c[1].pos IN ({listed})"


_POS_CODE = f"""CASE WHEN NOT ends_with(code, ':OTHER') THEN code ELSE substr(code, 1, 2) || CASE
  WHEN {_SAME} AND {_both_pos('VERB')} AND ((o[1].form = 'VBZ' AND c[1].form = 'VB') OR (o[1].form = 'VB' AND c[1].form = 'VBZ')) THEN 'VERB:SVA'
  WHEN {_SAME} AND {_both_pos('VERB')} AND o[1].form <> c[1].form AND 'VBD' IN (o[1].form, c[1].form) THEN 'VERB:TENSE'
  WHEN {_SAME} AND {_both_pos('VERB')} AND o[1].form <> c[1].form THEN 'VERB:FORM'
  WHEN {_SAME} AND {_both_pos('NOUN')} AND o[1].form <> c[1].form AND 'POS' IN (o[1].form, c[1].form) THEN 'NOUN:POSS'
  WHEN {_SAME} AND {_both_pos('NOUN')} AND o[1].form <> c[1].form THEN 'NOUN:NUM'
  WHEN {_SAME} AND {_both_pos('ADJ')} AND o[1].form <> c[1].form THEN 'ADJ:FORM'
  WHEN {_SAME} AND o[1].pos <> c[1].pos THEN 'MORPH'
  {' '.join(f"WHEN len(list_filter(list_concat(o, c), lambda r: r.pos <> '{p}')) = 0 THEN '{p}'" for p in _POS[:4])}
  ELSE 'OTHER' END END"""

ORACLES = {
    # A sentence whose only token was dropped has nothing left that a match could stand on.
    "e1_apply": f"""WITH {CLEAN}, fixed AS (SELECT doc_id, sent_idx, n, md5(array_to_string({sql_ws_tokens(sql_fix(sql_spaced('clean')))}, ' ')) AS digest FROM clean),
      kinds AS (SELECT *, unnest(['substituted', 'dropped', 'inserted']) AS kind FROM fixed)
      SELECT doc_id, sent_idx, kind, CASE WHEN kind = 'dropped' AND n = 1 THEN md5('') ELSE digest END AS digest FROM kinds""",
    # Flags of one sentence are whole tokens: of those on one token the first corrector's goes in.
    "e1_overlaps": f"""WITH {SENTS}, {FLAGS}, firsts AS (SELECT * FROM flags QUALIFY row_number() OVER
        (PARTITION BY doc_id, sent_idx, "offset" ORDER BY corrector_idx) = 1),
      laid AS (SELECT f.*, text, coalesce(lag("offset" + length) OVER w, 0) AS before FROM firsts f JOIN sents s USING (doc_id, sent_idx)
        WINDOW w AS (PARTITION BY doc_id, sent_idx ORDER BY "offset")),
      joined AS (SELECT doc_id, sent_idx, count(*) AS n, max("offset" + length) AS last,
        string_agg(substring(text, CAST(before + 1 AS BIGINT), CAST("offset" - before AS BIGINT)) || replacement, '' ORDER BY "offset") AS head FROM laid GROUP BY ALL)
      SELECT doc_id, sent_idx, md5(coalesce(head, '') || substring(text, CAST(coalesce(last, 0) + 1 AS BIGINT))) AS digest, coalesce(n, 0) AS n_applied
      FROM sents LEFT JOIN joined USING (doc_id, sent_idx)""",
    "e2_profile": f"""WITH {_KNOWN}, coded AS (SELECT doc_id, {_CODE} AS code FROM known),
      b AS (SELECT c.doc_id, regexp_replace(code, '^[^:]*:', '') AS bare, lang, CASE WHEN c.doc_id % 5 <> 0 THEN source END AS source
        FROM coded c JOIN documents d ON c.doc_id = d.doc_id),
      l AS (SELECT {_LABELS} AS label, lang, source FROM b)
      SELECT label, lang, source, grouping(label) = 1 AS total_label, grouping(lang) = 1 AS total_lang,
        grouping(source) = 1 AS total_source, count(*) AS n FROM l GROUP BY CUBE (label, lang, source)""",
    "e4_agreement": f"""WITH {SENTS}, {FLAGS}, keys AS (SELECT DISTINCT doc_id, sent_idx, "offset", length, replacement, corrector_idx AS c FROM flags),
      whole AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, sent_idx, "offset", length, replacement FROM keys)),
      sizes AS (SELECT i AS c, count(k.c) AS n FROM range({len(WORDS)}) r(i) LEFT JOIN keys k ON k.c = i GROUP BY i),
      met AS (SELECT a.c AS a, b.c AS b, count(*) AS n FROM keys a JOIN keys b USING (doc_id, sent_idx, "offset", length, replacement) GROUP BY ALL)
      SELECT x.c AS a, y.c AS b, coalesce(m.n, 0) AS "both", x.n AS n_a, y.n AS n_b,
        round(CAST(x.n * y.n AS DOUBLE) / w.n, 6) AS expected, round(CAST(coalesce(m.n, 0) AS DOUBLE) / (x.n + y.n - coalesce(m.n, 0)), 6) AS agreement
      FROM sizes x, sizes y, whole w LEFT JOIN met m ON m.a = x.c AND m.b = y.c""",
    "j5_bounded": f"""WITH {SENTS}, base AS (SELECT doc_id, text, doc_id * 7 + sent_idx % 5 AS asked FROM sents),
      dated AS (SELECT text, asked * 3 AS used FROM base WHERE doc_id IN (SELECT doc_id FROM labels)
        UNION ALL SELECT text, asked FROM base WHERE doc_id % 3 <> 0),
      latest AS (SELECT text, max(used) AS used FROM dated GROUP BY text ORDER BY used DESC, md5(text) LIMIT {CAPACITY})
      SELECT md5(text) AS text, used, md5({_CORRECTED}) AS digest FROM latest""",
    "t2_reuse": f"WITH {SENTS} SELECT doc_id, sent_idx, md5({_CORRECTED}) AS digest, CAST(1 AS BIGINT) AS most_stored FROM sents",
    "t1_match_rows": f"""WITH {SENTS}, {FLAGS}, firsts AS (SELECT * FROM flags QUALIFY row_number() OVER
        (PARTITION BY doc_id, sent_idx, "offset", length, replacement ORDER BY corrector_idx, match_idx) = 1)
      SELECT doc_id, sent_idx, row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY "offset", corrector_idx, match_idx) - 1 AS rank,
        "offset", length, replacement, corrector_idx, match_idx FROM firsts""",
    "a3_breaker": f"""WITH RECURSIVE s AS (SELECT 'rule' || (event_id % 40) AS rule_id, epoch_us(ts) // 1000000 AS second, count(*) AS n,
        count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY second) AS i FROM s),
      walk AS (
        SELECT rule_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS second, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS bad, false AS counted,
          [{{'s': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'b': CAST(0 AS BIGINT)}}][:0] AS held, CAST(0 AS BIGINT) AS calls,
          CAST(0 AS BIGINT) AS failures, false AS tripped, CAST(NULL AS BIGINT) AS down_until_ms FROM (SELECT DISTINCT rule_id FROM s)
        UNION ALL
        SELECT rule_id, i, second, n, bad, counted, CASE WHEN tripped THEN held[:0] ELSE held END, calls, failures, tripped,
          CASE WHEN tripped THEN second * 1000 + {BREAKER['down_ms']} WHEN counted THEN NULL ELSE down END
        FROM (SELECT *, counted AND calls >= {BREAKER['min_calls']} AND failures * 100.0 >= {BREAKER['threshold']} * calls AS tripped
          FROM (SELECT *, CASE WHEN counted THEN CAST(list_sum(list_transform(held, lambda x: x.n)) AS BIGINT) ELSE 0 END AS calls,
              CASE WHEN counted THEN CAST(list_sum(list_transform(held, lambda x: x.b)) AS BIGINT) ELSE 0 END AS failures
            FROM (SELECT r.rule_id, r.i, r.second, r.n, r.bad, w.down_until_ms AS down,
                w.down_until_ms IS NULL OR r.second * 1000 >= w.down_until_ms AS counted,
                CASE WHEN w.down_until_ms IS NULL OR r.second * 1000 >= w.down_until_ms THEN
                  list_filter(list_append(w.held, {{'s': r.second, 'n': r.n, 'b': r.bad}}), lambda x: x.s > r.second - {BREAKER['window_s']})
                  ELSE w.held END AS held
              FROM walk w JOIN r ON r.rule_id = w.rule_id AND r.i = w.i + 1))))
      SELECT rule_id, second, n, bad, counted, calls, failures, tripped, down_until_ms FROM walk WHERE i > 0""",
    "d9_pos": f"""WITH {_KNOWN}, all_edits AS (
        SELECT doc_id, sent_idx, kind, o_str, c_str, o_tok, c_tok FROM known
        UNION ALL SELECT doc_id, sent_idx, 'bent', t || e, t, [t || e], [t] FROM (SELECT doc_id, sent_idx, tok[k + 1] AS t,
          [{', '.join(repr(e) for e in _ENDINGS)}][(doc_id + sent_idx) % 4 + 1] AS e FROM clean) WHERE regexp_matches(t, '^\\p{{L}}+$')),
      coded AS (SELECT doc_id, sent_idx, kind, {_CODE} AS code, {_READ} FROM all_edits)
      SELECT doc_id, sent_idx, kind, {_POS_CODE} AS code FROM coded""",
}
