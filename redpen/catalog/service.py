"""Catalog: the main path, fan-out and reuse, merging, correctors, streams (J, M, U, T)."""

from pyspark.sql import functions as F

from redpen.catalog.base import (
    CLEAN, SENTS, SQL_LIB_TOKEN, documents, sentences, sql_lib_tokens, sql_rules, sql_token_rows,
    sql_ws_tokens, table, word_rule,
)
from redpen.catalog.flags import FLAGS, WORDS, flagged, flagged_rows
from redpen.functions import text as X
from redpen.operators import correctors as C
from redpen.operators import edits as E
from redpen.operators import fanout, merge, project
from redpen.plans import check
from redpen.sources import sinks, streams
from redpen.streaming import jobs

IDS = ["doc_id", "sent_idx"]

# Words of the test corpus and what the table-driven correctors make of them. No
# new word occurs in the corpus, and 'th' is corrected alike by two of them.
# A rule takes the separators with it, so words next to each other need a second turn.
_A = 2 * [word_rule("th", "thaw"), word_rule("er", "errand"), word_rule("hehely", "heavily")]
_B = 2 * [word_rule("th", "thaw"), word_rule("thhe", "thesis")]
_C = 2 * [word_rule("er", "ergo"), word_rule("thth", "thrift")] + [(r"(\p{L})([,;])", "$1 $2")]
CORRECTORS = [
    C.Corrector("tagger", kind="gector", rules=_A),
    C.Corrector("speller", kind="coedit", rule_id="SPELLER", rules=_B),
    C.Corrector("writer", kind="text2text", rules=_C),
]


def main_check(spark, sf):
    """All sentences to merged matches, one row per match, each distinct text checked once."""
    checked = check.check_sentences(sentences(spark, sf), CORRECTORS, once=True)
    return merge.flatten_results(checked, IDS)


def main_check_no_reuse(spark, sf):
    """The same without the distinct-text step: no shuffle of the sentences."""
    checked = check.check_sentences(sentences(spark, sf), CORRECTORS, once=False)
    return merge.flatten_results(checked, IDS)


def main_aligned(spark, sf):
    """One row per sentence: matches and failed correctors, zeros included."""
    checked = check.check_sentences(sentences(spark, sf), CORRECTORS, language="^(en|fr).*$")
    return checked.select(*IDS, F.size("matches").alias("n"), F.size("errors").alias("failed"))


def j1_fan_out(spark, sf):
    ids = [c.effective_rule_id for c in CORRECTORS]
    return fanout.fan_out(sentences(spark, sf).select(*IDS), ids)


def _rewritten(texts):
    return texts.withColumn("corrected", C.apply_rules(F.col("text"), _A + _B))


def j2_once_per_text(spark, sf):
    df = fanout.once_per_text(sentences(spark, sf).select(*IDS, "text"), _rewritten)
    return df.select(*IDS, F.md5("corrected").alias("digest"), (F.col("corrected") != F.col("text")).alias("changed"))


def _corrector_results(spark, sf):
    """Flags per sentence and corrector; some (text, corrector) calls fail."""
    base = flagged(sentences(spark, sf))
    each = fanout.fan_out(base.select(*IDS, "matches"), ["a", "b", "c"])
    mine = F.filter("matches", lambda m: m.corrector_idx == F.col("corrector_idx"))
    return each.select(
        *IDS, "corrector_idx", mine.alias("matches"),
        ((F.col("doc_id") + F.col("sent_idx") + F.col("corrector_idx")) % 5 != 0).alias("ok"),
    )


def j3_successful_only(spark, sf):
    df = fanout.successful_only(_corrector_results(spark, sf))
    return df.select(*IDS, "corrector_idx", F.size("matches").alias("n"))


def j4_pad_failures(spark, sf):
    results = fanout.successful_only(_corrector_results(spark, sf)).drop("ok")
    fanned = fanout.fan_out(sentences(spark, sf).select(*IDS), ["a", "b", "c"]).drop("rule_id")
    df = fanout.pad_failures(fanned, results, IDS)
    return df.select(*IDS, "corrector_idx", F.size("matches").alias("n"))


def _reuse(spark, sf):
    """Requests are all sentences; known are the texts of labelled documents."""
    base = sentences(spark, sf).select(*IDS, "text")
    known = base.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    cache = _rewritten(known.select("text").distinct())
    return fanout.reuse(base, cache, _rewritten)


def j5_reuse(spark, sf):
    results, _ = _reuse(spark, sf)
    return results.select(*IDS, "hit", F.md5("corrected").alias("digest"))


def j5_refill(spark, sf):
    _, cache = _reuse(spark, sf)
    return cache.select(F.md5("text").alias("text"), F.md5("corrected").alias("digest"))


def j7_align(spark, sf):
    base = sentences(spark, sf)
    nested = merge.nested_results(flagged_rows(base), IDS).select(*IDS, "matches")
    df = fanout.align(base.select(*IDS), nested, IDS)
    return df.select(*IDS, F.size("matches").alias("n"))


def m1_distinct(spark, sf):
    return merge.distinct_matches(flagged_rows(sentences(spark, sf)), IDS)


def m1_distinct_lists(spark, sf):
    """Key from suggested replacements, else suggestions, else nothing."""
    df = flagged_rows(sentences(spark, sf))
    suggested = F.when(F.col("corrector_idx") == 0, F.array(F.struct(F.col("replacement").alias("replacement"))))
    listed = F.when(F.col("corrector_idx") == 1, F.array("replacement"))
    df = df.withColumn("replacements", merge.replacement_list(suggested, listed)).drop("replacement")
    out = merge.distinct_matches(df, IDS)
    return out.withColumn("replacements", F.array_join("replacements", "|"))


def m2_ordered(spark, sf):
    return merge.order_matches(flagged_rows(sentences(spark, sf)), IDS)


def m3_flatten(spark, sf):
    merged = flagged(sentences(spark, sf)).select(*IDS, "matches")
    return merge.flatten_results(merged, IDS)


def m4_results(spark, sf):
    df = flagged(sentences(spark, sf)).select(*IDS, merge.merge_arrays(F.col("matches")).alias("matches"))
    items = F.transform("matches", lambda m: F.concat_ws(":", m.offset, m.length, m.replacement))
    return df.select(*IDS, F.md5(F.array_join(items, "|")).alias("items"), F.lit(merge.LANGUAGE).alias("language"),
                     F.lit(merge.LANGUAGE_CODE).alias("language_code"))


def m5_text_major(spark, sf):
    counted = _corrector_results(spark, sf).select(*IDS, "corrector_idx", F.size("matches").alias("n"))
    df = merge.text_major(counted, IDS)
    return df.select(*IDS, F.array_join(F.transform("results", lambda r: r.n), ",").alias("counts"))


def m6_isolated(spark, sf):
    df = flagged(sentences(spark, sf)).withColumn(
        "error", F.when((F.col("doc_id") + F.col("sent_idx")) % 7 == 0, "broken"))
    return merge.isolate_failures(df).select(*IDS, F.size("matches").alias("n"))


def m7_by_confidence(spark, sf):
    df = flagged_rows(sentences(spark, sf))
    score = (F.col("offset") * 37 + F.col("corrector_idx") * 11) % 100 / 100.0
    return merge.by_confidence(df.withColumn("score", score), IDS)


def _thee():
    """User function: rewrites an article, and gives nothing for texts with an 'x'."""
    def run(texts):
        return ["" if "x" in t else t.replace("the", "thee") for t in texts]

    return run


def u1_batches(spark, sf):
    df = C.rewrite_batches(sentences(spark, sf).select(*IDS, "text"), _thee, prompt="text", batch_size=8)
    return df.select(*IDS, F.md5("corrected").alias("digest"), F.col("error").isNotNull().alias("failed"))


def u2_rules(spark, sf):
    df = _rewritten(sentences(spark, sf).select(*IDS, "text"))
    return df.select(*IDS, F.md5("corrected").alias("digest"))


def _prompted():
    """User function that answers a prompt."""
    def run(prompts):
        return [p.removeprefix("Fix grammatical errors: ").replace("thth", "thrift") for p in prompts]

    return run


def u3_four_stages(spark, sf):
    """Prompt, batch prediction, extraction with suppression, projection."""
    model = C.Corrector("model", kind="coedit", batch_function=_prompted)
    asked = sentences(spark, sf).select(*IDS, "text")
    rewritten = C.rewrite(asked, model).withColumnRenamed("text", "original").drop("error")
    return E.typed_matches(rewritten, rule_id=model.effective_rule_id).drop("match_idx")


def _tags(spark, sf):
    """Pass 1: delete 'the', replace 'of', both against a sure KEEP; pass 2: append after token 0."""
    toks = project.tokens(sentences(spark, sf).select(*IDS, "text"), starts=False)
    options = F.array(
        F.struct(F.lit(1).alias("pass_no"), F.when(F.col("token") == "the", "$DELETE").when(
            F.col("token") == "of", "$REPLACE_off").alias("tag"), F.lit(0.9).alias("prob"), F.lit(0.8).alias("p_error")),
        F.struct(F.lit(1).alias("pass_no"), F.when(F.col("token").isin("the", "of"), "$KEEP").alias("tag"),
                 F.when(F.col("token") == "of", 0.85).otherwise(0.3).alias("prob"), F.lit(0.8).alias("p_error")),
        F.struct(F.lit(2).alias("pass_no"), F.when(F.col("pos") == 0, "$APPEND_well").alias("tag"),
                 F.lit(0.7).alias("prob"), F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.1).alias("p_error")),
    )
    rows = toks.select(*IDS, "pos", F.explode_outer(options).alias("o"))
    return rows.select(*IDS, "pos", "o.*").where(F.col("tag").isNotNull())


def u4_tags(spark, sf):
    df = C.apply_tags(sentences(spark, sf).select(*IDS, "text"), _tags(spark, sf), IDS,
                      keep_confidence=0.2, min_error_prob=0.5)
    return df.select(*IDS, F.md5("corrected").alias("digest"))


def u5_registry(spark, sf):
    entry = F.get(C.registry_columns(CORRECTORS), F.col("corrector_idx"))
    return flagged_rows(sentences(spark, sf)).groupBy("corrector_idx").agg(F.count("*").alias("n")).select(
        "corrector_idx", "n", entry["kind"].alias("kind"), entry["rule_id"].alias("rule_id"),
        entry["prompt_template"].alias("prompt_template"))


def t1_stream_check(spark, sf):
    """The main path over a document stream."""
    schema = table(spark, sf, "documents").schema
    stream = streams.stream_table(spark, f"{sf}/documents.parquet", schema).select("doc_id", "text", "lang")
    out = sinks.shared_folder(spark, "checked")
    jobs.run_available(jobs.check_stream(stream, CORRECTORS), out, out + "-state")
    return merge.flatten_results(spark.read.parquet(out), IDS)


def t2_first_seen(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = streams.stream_table(spark, f"{sf}/events.parquet", schema).select(F.col("ts").cast("timestamp").alias("ts"), "props")
    out = sinks.shared_folder(spark, "seen")
    jobs.run_available(jobs.first_seen(stream, "ts", ["props"], "60 days"), out, out + "-state")
    return spark.read.parquet(out).select("props")


def calls(events):
    """Call log from the event table."""
    return events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("event_id").alias("call_id"),
        F.concat(F.lit("rule"), F.col("user_id") % 2).alias("rule_id"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_ms"),
    )


def t3_sliding_failures(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = streams.stream_table(spark, f"{sf}/events.parquet", schema)
    out = sinks.shared_folder(spark, "rates")
    rates = jobs.sliding_failure_rates(calls(stream), "1 hour", "15 minutes", "10 minutes", 5, 30.0)
    jobs.run_available(rates, out, out + "-state")
    return spark.read.parquet(out).withColumn("failure_rate", F.round("failure_rate", 6))


QUERIES = {
    f.__name__: f
    for f in (
        main_check, main_check_no_reuse, main_aligned, j1_fan_out, j2_once_per_text, j3_successful_only, j4_pad_failures,
        j5_reuse, j5_refill, j7_align, m1_distinct, m1_distinct_lists, m2_ordered, m3_flatten, m4_results,
        m5_text_major, m6_isolated, m7_by_confidence, u1_batches, u2_rules, u3_four_stages, u4_tags,
        u5_registry, t1_stream_check, t2_first_seen, t3_sliding_failures,
    )
}

# --- SQL -------------------------------------------------------------------------
# The correctors above replace words one by one with words that occur nowhere else,
# so the edits are the positions at which the tokens differ.

_TOKENS = sql_token_rows("toks", "sents", "text", SQL_LIB_TOKEN)


def _edits_of(rules, idx, rule_id) -> str:
    new = sql_lib_tokens(sql_rules("text", rules))
    return f"""SELECT t.doc_id, t.sent_idx, start AS "offset", length(token) AS length, r.b[pos + 1] AS replacement,
      CAST({idx} AS BIGINT) AS corrector_idx, pos, '{rule_id}' AS rule_id
      FROM toks t JOIN (SELECT doc_id, sent_idx, {new} AS b FROM sents) r
        ON t.doc_id = r.doc_id AND t.sent_idx = r.sent_idx WHERE token <> r.b[pos + 1]"""


_MAIN = f"""WITH {SENTS}, {_TOKENS},
  found AS ({' UNION ALL '.join(_edits_of(c.rules, i, c.effective_rule_id) for i, c in enumerate(CORRECTORS))}),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_idx, corrector_idx ORDER BY pos) - 1 AS match_idx FROM found),
  firsts AS (SELECT * FROM numbered QUALIFY row_number() OVER (PARTITION BY doc_id, sent_idx, "offset", length, replacement
    ORDER BY corrector_idx, match_idx) = 1)
  SELECT doc_id, sent_idx, row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY "offset", corrector_idx, match_idx) - 1 AS rank,
    "offset", length, replacement, 'Other / Uncategorized' AS description, 'Other / Uncategorized' AS message, rule_id,
    CAST(2 AS BIGINT) AS match_type, corrector_idx, match_idx FROM firsts"""

_FANNED = f"""WITH {SENTS}, {FLAGS}, fan AS (SELECT doc_id, sent_idx, CAST(unnest([0, 1, 2]) AS BIGINT) AS corrector_idx FROM sents),
  counted AS (SELECT n.doc_id, n.sent_idx, n.corrector_idx, count(f."offset") AS n,
      (n.doc_id + n.sent_idx + n.corrector_idx) % 5 <> 0 AS ok
    FROM fan n LEFT JOIN flags f USING (doc_id, sent_idx, corrector_idx) GROUP BY ALL)"""
_FLAGGED = f"WITH {SENTS}, {FLAGS}"
_ARR = "corrector_idx, match_idx"
_CORRECTED = sql_rules("text", _A + _B)

ORACLES = {
    "main_check": _MAIN,
    "main_check_no_reuse": _MAIN,
    "t1_stream_check": _MAIN,
    "main_aligned": f"""WITH main AS ({_MAIN}), {SENTS} SELECT s.doc_id, s.sent_idx,
      count(m."offset") FILTER (lang LIKE 'en%' OR lang LIKE 'fr%') AS n, CAST(0 AS BIGINT) AS failed
      FROM sents s LEFT JOIN main m ON s.doc_id = m.doc_id AND s.sent_idx = m.sent_idx GROUP BY s.doc_id, s.sent_idx""",
    "j1_fan_out": f"""WITH {SENTS} SELECT doc_id, sent_idx, CAST(unnest([0, 1, 2]) AS BIGINT) AS corrector_idx,
      unnest([{', '.join(f"'{c.effective_rule_id}'" for c in CORRECTORS)}]) AS rule_id FROM sents""",
    "j2_once_per_text": f"""WITH {SENTS} SELECT doc_id, sent_idx, md5({_CORRECTED}) AS digest, {_CORRECTED} <> text AS changed FROM sents""",
    "j3_successful_only": f"{_FANNED} SELECT doc_id, sent_idx, corrector_idx, n FROM counted WHERE ok",
    "j4_pad_failures": f"{_FANNED} SELECT doc_id, sent_idx, corrector_idx, CASE WHEN ok THEN n ELSE 0 END AS n FROM counted",
    "j5_reuse": f"""WITH {SENTS}, known AS (SELECT DISTINCT text FROM sents WHERE doc_id IN (SELECT doc_id FROM labels))
      SELECT doc_id, sent_idx, text IN (SELECT text FROM known) AS hit, md5({_CORRECTED}) AS digest FROM sents""",
    "j5_refill": f"""WITH {SENTS}, d AS (SELECT DISTINCT text FROM sents) SELECT md5(text) AS text, md5({_CORRECTED}) AS digest FROM d""",
    "j7_align": f"""{_FLAGGED} SELECT s.doc_id, s.sent_idx, count("offset") AS n
      FROM sents s LEFT JOIN flags f USING (doc_id, sent_idx) GROUP BY ALL""",
    "m1_distinct": f"""{_FLAGGED} SELECT doc_id, sent_idx, "offset", length, replacement, corrector_idx, match_idx FROM flags
      QUALIFY row_number() OVER (PARTITION BY doc_id, sent_idx, "offset", length, replacement ORDER BY {_ARR}) = 1""",
    "m1_distinct_lists": f"""{_FLAGGED}, k AS (SELECT * EXCLUDE replacement, CASE WHEN corrector_idx < 2 THEN replacement ELSE '' END AS replacements FROM flags)
      SELECT doc_id, sent_idx, "offset", length, replacements, corrector_idx, match_idx FROM k
      QUALIFY row_number() OVER (PARTITION BY doc_id, sent_idx, "offset", length, replacements ORDER BY {_ARR}) = 1""",
    "m2_ordered": f"""{_FLAGGED} SELECT *, row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY "offset", {_ARR}) AS rank FROM flags""",
    "m3_flatten": f"""{_FLAGGED} SELECT *, row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY {_ARR}) - 1 AS rank FROM flags""",
    "m4_results": f"""{_FLAGGED}, firsts AS (SELECT * FROM flags
        QUALIFY row_number() OVER (PARTITION BY doc_id, sent_idx, "offset", length, replacement ORDER BY {_ARR}) = 1)
      SELECT s.doc_id, s.sent_idx, md5(coalesce(string_agg(concat_ws(':', "offset", length, replacement), '|'
        ORDER BY "offset", {_ARR}), '')) AS items, 'English' AS language, 'en-US' AS language_code
      FROM sents s LEFT JOIN firsts USING (doc_id, sent_idx) GROUP BY ALL""",
    "m5_text_major": f"""{_FANNED} SELECT doc_id, sent_idx, string_agg(n, ',' ORDER BY corrector_idx) AS counts FROM counted GROUP BY ALL""",
    "m6_isolated": f"""{_FLAGGED} SELECT s.doc_id, s.sent_idx, CASE WHEN (s.doc_id + s.sent_idx) % 7 = 0 THEN 0 ELSE count("offset") END AS n
      FROM sents s LEFT JOIN flags f USING (doc_id, sent_idx) GROUP BY s.doc_id, s.sent_idx""",
    "m7_by_confidence": f"""{_FLAGGED}, sc AS (SELECT *, CAST(("offset" * 37 + corrector_idx * 11) % 100 AS DOUBLE) / 100 AS score FROM flags)
      SELECT *, row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY score DESC, "offset", {_ARR}) AS rank FROM sc""",
    "u1_batches": f"""WITH {SENTS} SELECT doc_id, sent_idx, md5(CASE WHEN contains(text, 'x') THEN text ELSE replace(text, 'the', 'thee') END) AS digest,
      false AS failed FROM sents""",
    "u2_rules": f"WITH {SENTS} SELECT doc_id, sent_idx, md5({_CORRECTED}) AS digest FROM sents",
    "u3_four_stages": f"""WITH {SENTS}, {_TOKENS} SELECT doc_id, sent_idx, start AS "offset", length(token) AS length,
      replace(token, 'thth', 'thrift') AS replacement, 'Other / Uncategorized' AS description,
      'Other / Uncategorized' AS message, 'model' AS rule_id, CAST(2 AS BIGINT) AS match_type
      FROM toks WHERE contains(token, 'thth')""",
    "u4_tags": f"""WITH {SENTS}, w AS (SELECT doc_id, sent_idx, {sql_ws_tokens('text')} AS t FROM sents),
      p1 AS (SELECT doc_id, sent_idx, list_filter(t, lambda x: x <> 'the') AS a,
        len(t) > 0 AND doc_id % 2 = 0 AS sure FROM w)
      SELECT doc_id, sent_idx, md5(array_to_string(CASE WHEN sure AND len(a) > 0 THEN list_concat([a[1], 'well'], a[2:]) ELSE a END, ' ')) AS digest FROM p1""",
    "u5_registry": f"""{_FLAGGED}, reg AS (SELECT * FROM (VALUES {', '.join(
        f"({i}, '{c.kind}', '{c.effective_rule_id}', {'NULL' if c.template is None else chr(39) + c.template + chr(39)})"
        for i, c in enumerate(CORRECTORS))}) v(corrector_idx, kind, rule_id, prompt_template))
      SELECT f.corrector_idx, count(*) AS n, kind, rule_id, prompt_template FROM flags f JOIN reg r ON f.corrector_idx = r.corrector_idx GROUP BY ALL""",
    "t2_first_seen": "SELECT DISTINCT props FROM events",
    "t3_sliding_failures": """WITH calls AS (SELECT 'rule' || (user_id % 2) AS rule_id, epoch_us(ts) AS us, event_type <> 'error' AS ok FROM events),
      slid AS (SELECT rule_id, ok, (us // 900000000 - unnest(range(4))) * 900 AS window_start FROM calls),
      agg AS (SELECT rule_id, window_start, window_start + 3600 AS window_end, count(*) AS calls, count(*) FILTER (NOT ok) AS failures
        FROM slid GROUP BY ALL)
      SELECT *, round(failures * 100.0::DOUBLE / calls, 6) AS failure_rate, failures * 100.0 / calls >= 30 AS open FROM agg
      WHERE calls >= 5 AND window_end * 1000 <= (SELECT max(us) // 1000 FROM calls) - 600000""",
}
