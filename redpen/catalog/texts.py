"""Catalog: sources, sinks, projections (S, P)."""

from pyspark.sql import functions as F

from redpen.catalog.base import (
    CLEAN, SENTS, SQL_NS, clean, sentences, sql_emoji, sql_fix, sql_spaced, sql_token_rows, table,
)
from redpen.catalog.flags import FLAGS, flagged_rows
from redpen.functions import patterns as P
from redpen.functions import text as X
from redpen.operators import project
from redpen.plans import damage
from redpen.sources import scan, sinks, streams
from redpen.streaming import jobs


def s1_scan(spark, sf):
    df = scan.read_documents(spark, f"{sf}/documents.parquet")
    return df.select("doc_id", F.md5("text").alias("digest"))


def s2_rewrites(spark, sf):
    path = sinks.shared_folder(spark, "rewrites")
    pairs = damage.substituted(clean(spark, sf)).withColumn("corrector_idx", F.lit(0))
    pairs.write.parquet(path)
    back = scan.read_rewrites(spark, path)
    return back.select(
        "doc_id", "sent_idx", "corrector_idx", F.md5("original").alias("o"), F.md5("corrected").alias("c")
    )


def s3_first_rows(spark, sf):
    return scan.first_rows(table(spark, sf, "benchmark"), "item_id", 20)


def s4_sink(spark, sf):
    path = sinks.shared_folder(spark, "nested")
    base = sentences(spark, sf)
    sinks.write_nested(flagged_rows(base), path, ["doc_id", "sent_idx"], base)
    back = spark.read.parquet(path)
    items = F.transform("matches", lambda m: F.concat_ws(":", m.offset, m.length, m.replacement))
    return back.select("doc_id", "sent_idx", F.md5(F.array_join(items, "|")).alias("items"),
                       F.size("matches").alias("n"))


def s5_stream(spark, sf):
    schema = table(spark, sf, "documents").schema
    out = sinks.shared_folder(spark, "stream")
    stream = project.sentences(
        streams.stream_table(spark, f"{sf}/documents.parquet", schema).select("doc_id", "text")
    )
    jobs.run_available(stream, out, out + "-state")
    return spark.read.parquet(out).select("doc_id", "sent_idx", F.md5("text").alias("digest"))


def p1_sentences(spark, sf):
    return sentences(spark, sf).select("doc_id", "sent_idx", "text")


def p2_tokens(spark, sf):
    return project.tokens(sentences(spark, sf).select("doc_id", "sent_idx", "text"))


def p3_analyzed(spark, sf):
    return project.analyzed_tokens(sentences(spark, sf).select("doc_id", "sent_idx", "text"))


def p4_fix_tokenization(spark, sf):
    df = clean(spark, sf)
    noisy = damage.spaced(F.col("clean"))
    return df.select(
        "doc_id", "sent_idx", F.md5(X.fix_tokenization(noisy)).alias("fixed"),
        (X.fix_tokenization(noisy) != noisy).alias("changed"),
    )


def p5_prompt(spark, sf):
    df = project.with_prompt(sentences(spark, sf))
    return df.select("doc_id", "sent_idx", "prompt")


def p6_eligible(spark, sf):
    return project.eligible(sentences(spark, sf)).select("doc_id", "sent_idx", "lang")


def p7_time_budget(spark, sf):
    return project.with_time_budget(sentences(spark, sf)).select("doc_id", "sent_idx", "budget_ms")


def p8_wire(spark, sf):
    df = flagged_rows(sentences(spark, sf))
    df = df.withColumns(
        {
            "rule_id": F.when(F.col("corrector_idx") == 1, "").otherwise(F.concat(F.lit("r"), "corrector_idx")),
            "message": F.when(F.col("corrector_idx") != 2, F.col("replacement")),
            "confidence": F.when(F.col("corrector_idx") == 0, F.lit(0.5)).cast("float"),
            "rule": F.when(
                F.col("corrector_idx") > 0,
                F.struct(
                    F.lit("").alias("id"),
                    F.when(F.col("corrector_idx") == 1, "why").alias("description"),
                    F.lit(None).cast("string").alias("issue_type"),
                    F.when(F.col("corrector_idx") == 2, F.struct(F.lit("x").alias("id"))).alias("category"),
                ),
            ),
        }
    )
    out = project.wire_matches(df)
    first = F.get("suggested_replacements", F.lit(0))
    return out.select(
        "doc_id", "sent_idx", "offset", "length", "replacement", "corrector_idx", "id", "sub_id",
        F.size("suggestions").alias("n_suggestions"), "match_description", "match_short_description",
        "confidence", "auto_correct", "type", "context_for_sure_match", "rule_description",
        F.col("rule.source_file").alias("source_file"), F.col("rule.issue_type").alias("issue_type"),
        F.col("rule.category.name").alias("category_name"), F.size("rule.tags").alias("n_tags"),
        F.size("suggested_replacements").alias("n_replacements"),
        first["replacement"].alias("first_replacement"), first["description"].alias("first_description"),
        first["suffix"].alias("first_suffix"), first["confidence"].alias("first_confidence"),
    )


def p9_shift(spark, sf):
    base = sentences(spark, sf)
    df = project.shift_offsets(flagged_rows(base, extra=["sent_start"]), "sent_start")
    return df.select("doc_id", "sent_idx", "corrector_idx", "offset", "length")


def p10_emoji(spark, sf):
    df = sentences(spark, sf)
    return df.select("doc_id", "sent_idx",
                     F.md5(X.normalise_emoji(F.concat("text", F.lit(" 😀‍👍  x")))).alias("digest"))


def p11_span_text(spark, sf):
    df = flagged_rows(sentences(spark, sf), extra=["text"])
    return df.select(
        "doc_id", "sent_idx", "corrector_idx", "offset",
        X.span_text(F.col("text"), F.col("offset"), F.col("length")).alias("span"),
        X.utf16_offset(F.col("text"), F.col("offset")).alias("offset_utf16"),
    )


def p12_code_names(spark, sf):
    df = flagged_rows(sentences(spark, sf))
    code = F.col("match_idx") % 10
    return df.groupBy(
        X.code_name(F.col("corrector_idx"), P.MATCH_TYPES).alias("match_type"),
        X.code_name(F.col("corrector_idx"), P.SUGGESTION_TYPES).alias("suggestion_type"),
        X.code_name(code, P.STYLE_TAGS).alias("tag"),
    ).agg(F.count("*").alias("n"))


def _names(column: str, names: dict[int, str]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = {k} THEN '{v}'" for k, v in names.items()) + " END"


QUERIES = {
    f.__name__: f
    for f in (
        s1_scan, s2_rewrites, s3_first_rows, s4_sink, s5_stream, p1_sentences, p2_tokens, p3_analyzed,
        p4_fix_tokenization, p5_prompt, p6_eligible, p7_time_budget, p8_wire, p9_shift, p10_emoji,
        p11_span_text, p12_code_names,
    )
}

_TOKENS = sql_token_rows("toks", "sents", "text", SQL_NS + "+")

ORACLES = {
    "s1_scan": "SELECT doc_id, md5(text) AS digest FROM documents",
    "s2_rewrites": f"""WITH {CLEAN} SELECT doc_id, sent_idx, CAST(0 AS BIGINT) AS corrector_idx,
      md5(array_to_string(list_transform(tok, lambda t, i: CASE WHEN i - 1 = k THEN reverse(t) ELSE t END), ' ')) AS o,
      md5({sql_spaced('clean')}) AS c FROM clean""",
    "s3_first_rows": "SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 20",
    "s4_sink": f"""WITH {SENTS}, {FLAGS}
      SELECT s.doc_id, s.sent_idx, md5(coalesce(string_agg(concat_ws(':', "offset", length, replacement), '|'
             ORDER BY "offset", corrector_idx, match_idx), '')) AS items, count("offset") AS n
      FROM sents s LEFT JOIN flags f USING (doc_id, sent_idx) GROUP BY ALL""",
    "s5_stream": f"WITH {SENTS} SELECT doc_id, sent_idx, md5(text) AS digest FROM sents",
    "p1_sentences": f"WITH {SENTS} SELECT doc_id, sent_idx, text FROM sents",
    "p2_tokens": f"WITH {SENTS}, {_TOKENS} SELECT doc_id, sent_idx, pos, token, start FROM toks",
    "p3_analyzed": f"""WITH {SENTS}, {_TOKENS} SELECT doc_id, sent_idx, pos, token, 'NN' AS pos_tag,
      lower(token) AS lemma, CAST(coalesce(sum(length(token) + 1) OVER (PARTITION BY doc_id, sent_idx ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_pos FROM toks""",
    "p4_fix_tokenization": f"""WITH {CLEAN}, noisy AS (SELECT doc_id, sent_idx, {sql_spaced('clean')} AS x FROM clean),
      done AS (SELECT *, {sql_fix('x')} AS y FROM noisy)
      SELECT doc_id, sent_idx, md5(y) AS fixed, x <> y AS changed FROM done""",
    "p5_prompt": f"WITH {SENTS} SELECT doc_id, sent_idx, 'Fix grammatical errors: ' || text AS prompt FROM sents",
    "p6_eligible": f"""WITH {SENTS} SELECT doc_id, sent_idx, lang FROM sents
      WHERE regexp_matches(lang, '^en.*$') AND length(text) <= 1000""",
    "p7_time_budget": f"WITH {SENTS} SELECT doc_id, sent_idx, 5000 + 100 * length(text) AS budget_ms FROM sents",
    "p8_wire": f"""WITH {SENTS}, {FLAGS} SELECT doc_id, sent_idx, "offset", length, replacement, corrector_idx,
      CASE corrector_idx WHEN 1 THEN '{P.DEFAULT_RULE_ID}' ELSE 'r' || corrector_idx END AS id, '' AS sub_id,
      CAST(0 AS BIGINT) AS n_suggestions,
      CASE WHEN corrector_idx <> 2 THEN replacement ELSE '' END AS match_description,
      CASE WHEN corrector_idx <> 2 THEN replacement ELSE '' END AS match_short_description,
      CAST(CASE WHEN corrector_idx = 0 THEN 0.5 ELSE -1 END AS DOUBLE) AS confidence, true AS auto_correct,
      CAST(0 AS BIGINT) AS type, CAST(0 AS BIGINT) AS context_for_sure_match,
      CASE corrector_idx WHEN 1 THEN 'why' END AS rule_description,
      CASE WHEN corrector_idx > 0 THEN '{P.DEFAULT_SOURCE_FILE}' END AS source_file,
      CASE WHEN corrector_idx > 0 THEN 'style' END AS issue_type,
      CASE WHEN corrector_idx = 2 THEN 'Style Suggestion' END AS category_name,
      CASE WHEN corrector_idx > 0 THEN CAST(0 AS BIGINT) ELSE NULL END AS n_tags, CAST(1 AS BIGINT) AS n_replacements,
      replacement AS first_replacement, '' AS first_description, '' AS first_suffix,
      CAST(CASE WHEN corrector_idx = 0 THEN 0.5 ELSE -1 END AS DOUBLE) AS first_confidence
      FROM flags""",
    "p9_shift": f"""WITH {SENTS}, {FLAGS}, st AS (SELECT doc_id, sent_idx, coalesce(sum(length(text) + 2) OVER
        (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_start FROM sents)
      SELECT doc_id, sent_idx, corrector_idx, CAST("offset" + sent_start AS BIGINT) AS "offset", length
      FROM flags JOIN st USING (doc_id, sent_idx)""",
    "p10_emoji": f"WITH {SENTS} SELECT doc_id, sent_idx, md5({sql_emoji(chr(40) + 'text || ' + chr(39) + ' 😀' + chr(0x200d) + '👍  x' + chr(39) + chr(41))}) AS digest FROM sents",
    "p11_span_text": f"""WITH {SENTS}, {FLAGS}, told AS MATERIALIZED (
        SELECT doc_id, sent_idx, text, regexp_matches(text, '[\\x{{10000}}-\\x{{10FFFF}}]') AS astral FROM sents)
      SELECT f.doc_id, f.sent_idx, corrector_idx, "offset",
      substring(text, CAST("offset" + 1 AS BIGINT), length) AS span,
      "offset" + CASE WHEN astral THEN length(regexp_replace(substring(text, 1, CAST("offset" AS BIGINT)), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))
        ELSE 0 END AS offset_utf16
      FROM flags f JOIN told USING (doc_id, sent_idx)""",
    "p12_code_names": f"""WITH {SENTS}, {FLAGS} SELECT {_names('corrector_idx', P.MATCH_TYPES)} AS match_type,
      {_names('corrector_idx', P.SUGGESTION_TYPES)} AS suggestion_type,
      {_names('(match_idx % 10)', P.STYLE_TAGS)} AS tag, count(*) AS n FROM flags GROUP BY ALL""",
}
