"""Catalog: classifier inputs and outputs, run logs (C, A)."""

from pyspark.sql import functions as F

from redpen.catalog.base import SENTS, r6, sentences, table
from redpen.catalog.flags import FLAGS, flagged, flagged_rows
from redpen.catalog.service import calls
from redpen.functions import scores as S
from redpen.operators import classify, merge, runs

IDS = ["doc_id", "sent_idx"]
LABELS = {0: "none", 1: "minor", 2: "major"}
CALIBRATORS = [
    ([1.5, -0.5, 0.25, 0.0], 0.1), ([-0.75, 2.0, 0.5, 0.25], -0.2),
    ([0.5, 0.5, -1.0, 1.0], 0.0), ([0.0, -0.25, 0.75, 1.5], 0.3),
]


def _ordered(spark, sf):
    df = flagged(sentences(spark, sf)).select(*IDS, "text", "matches")
    return df.withColumn("matches", merge.merge_arrays(F.col("matches")))


def c1_feature(spark, sf):
    """All corrections of a sentence marked, the middle one selected."""
    df = _ordered(spark, sf)
    middle = F.floor(F.size("matches") / 2).cast("int")
    return df.select(*IDS, F.md5(classify.feature(F.col("text"), F.col("matches"), middle)).alias("digest"))


def c2_features(spark, sf):
    df = classify.features_per_match(_ordered(spark, sf))
    return df.select(*IDS, "selected", F.md5("feature").alias("digest"))


def c2_features_no_overlap(spark, sf):
    df = classify.features_per_match(_ordered(spark, sf), overlaps=False)
    return df.select(*IDS, "selected", F.md5("feature").alias("digest"))


def _by_length():
    """User classifier: parity and length of the feature."""
    def run(features):
        return [f'{{"label": "{"odd" if len(f) % 2 else "even"}", "score": {len(f) % 100 / 100}}}' for f in features]

    return run


def c12_scored_matches(spark, sf):
    df = classify.classify_matches(_ordered(spark, sf), _by_length)
    return df.select(*IDS, "selected", "label", r6("score").alias("score"), F.col("error").isNotNull().alias("failed"))


def _every_fourth(j):
    return lambda v, i: i % 4 == j


def _logits(spark, sf):
    """Four logits from all values of a vector: sums of every fourth one."""
    df = table(spark, sf, "embeddings")
    parts = [
        F.aggregate(
            F.filter("embedding", _every_fourth(j)), F.lit(0.0), lambda acc, v: acc + v.cast("double")
        )
        for j in range(4)
    ]
    return df.select("vec_id", F.array(*parts).alias("logits"))


def _vector(probs):
    return F.array_join(F.transform(probs, lambda p: F.format_string("%.5f", p)), ",")


def _flat(df, column="probs"):
    return df.select("vec_id", F.posexplode(column).alias("class_id", "p")).withColumn("p", r6("p"))


def c3_calibrated(spark, sf):
    return _flat(classify.with_probabilities(_logits(spark, sf), CALIBRATORS))


def c4_softmax(spark, sf):
    return _flat(classify.with_probabilities(_logits(spark, sf)))


def c5_top_labels(spark, sf):
    df = classify.top_labels(classify.with_probabilities(_logits(spark, sf), CALIBRATORS), 2, LABELS)
    return df.withColumn("score", r6("score"))


def c6_best_label(spark, sf):
    df = classify.best_label(classify.with_probabilities(_logits(spark, sf)), LABELS)
    return df.select("vec_id", "class_id", r6("score").alias("score"))


def c7_label_names(spark, sf):
    df = classify.best_label(classify.with_probabilities(_logits(spark, sf)), LABELS)
    plain = S.label_name(F.col("class_id"))
    return df.groupBy("label", plain.alias("plain_label")).agg(F.count("*").alias("n"))


def c8_vector(spark, sf):
    """Ranked outputs put back into the order of their label ids."""
    df = classify.with_probabilities(_logits(spark, sf), CALIBRATORS)
    ranked = F.transform(
        S.ranked(F.col("probs")),
        lambda r: F.struct(S.label_name(r.class_id, LABELS).alias("label"), r.score.alias("score")),
    )
    ids = {S_label: i for i, S_label in {**LABELS, 3: "LABEL_3"}.items()}
    return _flat(df.select("vec_id", classify.probability_vector(ranked, ids).alias("probs")))


def c9_both(spark, sf):
    df = classify.with_probabilities(_logits(spark, sf), CALIBRATORS, uncalibrated=True)
    both = F.arrays_zip("probs", "raw_probs")
    return df.select("vec_id", F.posexplode(both).alias("class_id", "b")).select(
        "vec_id", "class_id", r6("b.probs").alias("p"), r6("b.raw_probs").alias("raw_p"))


def _payloads(spark, sf):
    e, kind = table(spark, sf, "events"), F.col("event_type")
    good = F.concat(F.lit('{"label": "'), kind, F.lit('", "score": '), F.col("event_id") % 100 / 80.0, F.lit("}"))
    payload = (
        F.when(kind == "view", good).when(kind == "signup", good).when(kind == "click", F.col("props"))
        .when(kind == "purchase", F.substring("props", 1, 5)).otherwise(F.concat(F.lit("oops "), "props"))
    )
    return e.select("event_id", S.parsed_output(payload).alias("o")).select("event_id", "o.*")


def c10_parsed(spark, sf):
    return _payloads(spark, sf).withColumn("score", r6("score"))


def c11_range(spark, sf):
    return classify.range_violations(_payloads(spark, sf))


def _calls(spark, sf):
    return calls(table(spark, sf, "events"))


def a1_summary(spark, sf):
    df = runs.run_summary(_calls(spark, sf))
    return df.withColumns({"elapsed_s": r6("elapsed_s"), "throughput": r6("throughput")})


def a2_running_throughput(spark, sf):
    df = runs.running_throughput(_calls(spark, sf))
    return df.withColumns({"elapsed_s": r6("elapsed_s"), "throughput": r6("throughput")})


def a3_failure_rates(spark, sf):
    df = runs.failure_rates(_calls(spark, sf), window_s=3600, min_calls=5, threshold=30.0)
    return df.withColumn("failure_rate", r6("failure_rate"))


def a4_percentiles(spark, sf):
    df = runs.latency_percentiles(_calls(spark, sf), [0.5, 0.99])
    return df.withColumns({"value": r6("value"), "within_bound": F.col("max") < 5000.0})


def a5_matches_per(spark, sf):
    df = flagged_rows(sentences(spark, sf))
    by_corrector = runs.matches_per(df, ["corrector_idx"]).select(
        F.lit(-1).alias("doc_id"), F.lit(-1).alias("sent_idx"), "corrector_idx", "n_matches")
    by_sentence = runs.matches_per(df, IDS).select(*IDS, F.lit(-1).alias("corrector_idx"), "n_matches")
    return by_corrector.unionByName(by_sentence)


def a6_micro_batches(spark, sf):
    return runs.micro_batches(sentences(spark, sf), "sent_idx", 8).groupBy("doc_id", "batch").agg(
        F.count("*").alias("n"))


def a7_consistency(spark, sf):
    df = _ordered(spark, sf)
    items = F.transform("matches", lambda m: F.concat_ws(":", m.offset, m.length, m.replacement))
    df = df.select("text", F.xxhash64(F.array_join(items, "|")).alias("digest"))
    out = runs.repeat_consistency(df)
    return out.select(F.md5("text").alias("text"), "n", "consistent")


QUERIES = {
    f.__name__: f
    for f in (
        c1_feature, c2_features, c2_features_no_overlap, c12_scored_matches, c3_calibrated, c4_softmax, c5_top_labels, c6_best_label,
        c7_label_names, c8_vector, c9_both, c10_parsed, c11_range, a1_summary, a2_running_throughput,
        a3_failure_rates, a4_percentiles, a5_matches_per, a6_micro_batches, a7_consistency,
    )
}

# --- SQL -------------------------------------------------------------------------

_FIRSTS = f"""WITH {SENTS}, {FLAGS}, firsts AS (SELECT * FROM flags QUALIFY row_number() OVER
    (PARTITION BY doc_id, sent_idx, "offset", length, replacement ORDER BY corrector_idx, match_idx) = 1)"""


def _segments(source: str) -> str:
    """Gap, mark and index of each match; ends of the last match per sentence."""
    return f"""ranked AS (SELECT f.*, s.text, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY f.doc_id, f.sent_idx) AS k,
        coalesce(lag("offset" + length) OVER w, 0) AS pointer
      FROM {source} f JOIN sents s USING (doc_id, sent_idx)
      WINDOW w AS (PARTITION BY f.doc_id, f.sent_idx ORDER BY "offset", corrector_idx, match_idx)),
    segs AS (SELECT doc_id, sent_idx, text, i, k, CASE WHEN "offset" > pointer THEN substring(text, CAST(pointer + 1 AS BIGINT), CAST("offset" - pointer AS BIGINT)) ELSE '' END AS gap,
        '<|start_of_replace|>' || substring(text, CAST("offset" + 1 AS BIGINT), length) || '<SEP>' || replacement || '<|end_of_replace|>' AS mark,
        CASE WHEN "offset" + length < length(text) THEN substring(text, CAST("offset" + length + 1 AS BIGINT)) ELSE '' END AS tail FROM ranked),
    nested AS (SELECT doc_id, sent_idx, max(k) AS k, list(gap ORDER BY i) AS gaps, list(mark ORDER BY i) AS marks,
        list(tail ORDER BY i DESC)[1] AS tail FROM segs GROUP BY doc_id, sent_idx)"""


_FEATURE = """array_to_string(list_transform(range(1, k + 1), lambda j: gaps[j] || CASE WHEN j - 1 = {sel} THEN '<CLS>' ELSE '' END || marks[j]), '') || tail"""
_X = """list_transform([0, 1, 2, 3], lambda j: list_sum(list_transform(
  list_filter(embedding, lambda v, i: (i - 1) % 4 = j), lambda v: CAST(v AS DOUBLE))))"""
_LOGITS = f"x AS (SELECT vec_id, {_X} AS x FROM embeddings)"


def _sigmoid(coef, b):
    dot = " + ".join(f"CAST({c!r} AS DOUBLE) * x[{i + 1}]" for i, c in enumerate(coef))
    return f"1 / (1 + exp(-({dot} + CAST({b!r} AS DOUBLE))))"


_CAL = f"""{_LOGITS}, w AS (SELECT vec_id, [{', '.join(_sigmoid(c, b) for c, b in CALIBRATORS)}] AS w FROM x),
  pr AS (SELECT vec_id, list_transform(w, lambda v: v / list_sum(w)) AS p FROM w)"""
_SOFT = f"""{_LOGITS}, e AS (SELECT vec_id, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM x),
  raw AS (SELECT vec_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e)"""
_NAME = "CASE class_id " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in LABELS.items()) + " ELSE 'LABEL_' || class_id END"


def _rows(source: str) -> str:
    return f"flat AS (SELECT vec_id, unnest(range(4)) AS class_id, unnest(p) AS p FROM {source})"


_BEST = f"""WITH {_SOFT}, {_rows('raw')}, best AS (SELECT * FROM flat QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class_id) = 1)"""
_PARSED = """p AS (SELECT event_id, CASE WHEN event_type IN ('view', 'signup') THEN '{"label": "' || event_type || '", "score": ' || ((event_id % 100) / 80.0::DOUBLE) || '}'
    WHEN event_type = 'click' THEN props WHEN event_type = 'purchase' THEN substring(props, 1, 5) ELSE 'oops ' || props END AS j FROM events),
  parsed AS (SELECT event_id, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.label') ELSE 'unknown' END AS label,
    CASE WHEN json_valid(j) THEN CAST(json_extract_string(j, '$.score') AS DOUBLE) ELSE 0.0 END AS score FROM p)"""
_CALLS = """calls AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, event_id AS call_id, 'rule' || (user_id % 2) AS rule_id, epoch_us(ts) AS us,
    event_type <> 'error' AS ok, value AS latency_ms FROM events)"""

ORACLES = {
    "c1_feature": f"""{_FIRSTS}, {_segments('firsts')} SELECT s.doc_id, s.sent_idx,
      md5(CASE WHEN k IS NULL THEN text ELSE {_FEATURE.format(sel='k // 2')} END) AS digest
      FROM sents s LEFT JOIN nested n USING (doc_id, sent_idx)""",
    "c2_features": f"""{_FIRSTS}, {_segments('firsts')}, sel AS (SELECT *, unnest(range(k)) AS selected FROM nested)
      SELECT doc_id, sent_idx, selected, md5({_FEATURE.format(sel='selected')}) AS digest FROM sel""",
    "c12_scored_matches": f"""{_FIRSTS}, {_segments('firsts')}, sel AS (SELECT *, unnest(range(k)) AS selected FROM nested),
      f AS (SELECT doc_id, sent_idx, selected, length({_FEATURE.format(sel='selected')}) AS n FROM sel)
      SELECT doc_id, sent_idx, selected, CASE WHEN n % 2 = 1 THEN 'odd' ELSE 'even' END AS label,
        round((n % 100) / 100.0::DOUBLE, 6) AS score, false AS failed FROM f""",
    # Flags of one sentence overlap only on the very same token: keep the first.
    "c2_features_no_overlap": f"""{_FIRSTS}, kept AS (SELECT * FROM firsts QUALIFY row_number() OVER
        (PARTITION BY doc_id, sent_idx, "offset" ORDER BY corrector_idx, match_idx) = 1),
      {_segments('kept')}, sel AS (SELECT *, unnest(range(k)) AS selected FROM nested)
      SELECT doc_id, sent_idx, selected, md5({_FEATURE.format(sel='selected')}) AS digest FROM sel""",
    "c3_calibrated": f"WITH {_CAL}, {_rows('pr')} SELECT vec_id, class_id, round(p, 6) AS p FROM flat",
    "c4_softmax": f"WITH {_SOFT}, {_rows('raw')} SELECT vec_id, class_id, round(p, 6) AS p FROM flat",
    "c5_top_labels": f"""WITH {_CAL}, {_rows('pr')}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class_id) AS rank FROM flat)
      SELECT vec_id, rank, class_id, {_NAME} AS label, round(p, 6) AS score FROM r WHERE rank <= 2""",
    "c6_best_label": f"{_BEST} SELECT vec_id, class_id, round(p, 6) AS score FROM best",
    "c7_label_names": f"{_BEST} SELECT {_NAME} AS label, 'LABEL_' || class_id AS plain_label, count(*) AS n FROM best GROUP BY ALL",
    "c8_vector": f"WITH {_CAL}, {_rows('pr')} SELECT vec_id, class_id, round(p, 6) AS p FROM flat",
    "c9_both": f"""WITH {_CAL}, {_SOFT.split(',', 1)[1].split('FROM embeddings),', 1)[1]},
      a AS (SELECT vec_id, unnest(range(4)) AS class_id, unnest(p) AS p FROM pr), b AS (SELECT vec_id, unnest(range(4)) AS class_id, unnest(p) AS q FROM raw)
      SELECT vec_id, class_id, round(p, 6) AS p, round(q, 6) AS raw_p FROM a JOIN b USING (vec_id, class_id)""",
    "c10_parsed": f"WITH {_PARSED} SELECT event_id, label, round(score, 6) AS score FROM parsed",
    "c11_range": f"""WITH {_PARSED}, v AS (SELECT coalesce(label IS NOT NULL AND score BETWEEN 0 AND 1, false) AS ok FROM parsed)
      SELECT count(*) AS n, count(*) FILTER (ok) AS n_valid, count(*) FILTER (NOT ok) AS n_invalid FROM v""",
    "a1_summary": f"""WITH {_CALLS} SELECT run_id, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures,
      round((max(us) - min(us)) / 1e6, 6) AS elapsed_s, round(count(*) FILTER (ok) / nullif((max(us) - min(us)) / 1e6, 0), 6) AS throughput
      FROM calls GROUP BY run_id""",
    "a2_running_throughput": f"""WITH {_CALLS}, r AS (SELECT run_id, us, row_number() OVER (PARTITION BY run_id ORDER BY us, call_id) AS completed,
        count(*) OVER (PARTITION BY run_id) AS total, min(us) OVER (PARTITION BY run_id) AS start FROM calls)
      SELECT run_id, completed, round((us - start) / 1e6, 6) AS elapsed_s, round(completed / nullif((us - start) / 1e6, 0), 6) AS throughput
      FROM r WHERE completed % 100 = 0 OR completed = total""",
    "a3_failure_rates": f"""WITH {_CALLS}, s AS (SELECT rule_id, us // 1000000 AS second, count(*) AS n, count(*) FILTER (NOT ok) AS bad FROM calls GROUP BY ALL),
      r AS (SELECT rule_id, second, CAST(sum(n) OVER w AS BIGINT) AS calls, CAST(sum(bad) OVER w AS BIGINT) AS failures FROM s
        WINDOW w AS (PARTITION BY rule_id ORDER BY second RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW))
      SELECT rule_id, second, calls, failures, round(failures * 100.0::DOUBLE / calls, 6) AS failure_rate,
        calls >= 5 AND failures * 100.0 / calls >= 30 AS open,
        CASE WHEN calls >= 5 AND failures * 100.0 / calls >= 30 THEN second * 1000 + 5000 END AS down_until_ms FROM r""",
    "a4_percentiles": f"""WITH {_CALLS}, q AS (SELECT rule_id, count(latency_ms) AS n, max(latency_ms) AS max, quantile_cont(latency_ms, 0.5) AS q50,
        quantile_cont(latency_ms, 0.99) AS q99 FROM calls GROUP BY rule_id)
      SELECT rule_id, unnest([0.5::DOUBLE, 0.99::DOUBLE]) AS point, n, max, round(unnest([q50, q99]), 6) AS value, max < 5000 AS within_bound FROM q""",
    "a5_matches_per": f"""WITH {SENTS}, {FLAGS} SELECT CAST(-1 AS BIGINT) AS doc_id, CAST(-1 AS BIGINT) AS sent_idx, corrector_idx, count(*) AS n_matches FROM flags GROUP BY ALL
      UNION ALL SELECT doc_id, sent_idx, CAST(-1 AS BIGINT), count(*) FROM flags GROUP BY ALL""",
    "a6_micro_batches": f"""WITH {SENTS}, b AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) - 1) // 8 AS batch FROM sents)
      SELECT doc_id, batch, count(*) AS n FROM b GROUP BY ALL""",
    "a7_consistency": f"WITH {SENTS} SELECT md5(text) AS text, count(*) AS n, true AS consistent FROM sents GROUP BY sents.text",
}
