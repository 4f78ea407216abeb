"""Row-wise operators: sentences, tokens, eligibility, wire form."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.functions import patterns as P
from redpen.functions import text as X


def sentences(documents: DataFrame) -> DataFrame:
    """Split ``text`` at ``". "``: the delimiter goes, empty tails stay, newlines do not split.

    Adds ``sent_idx`` and ``sent_start``, the offset of the sentence in its document.
    """
    keep = [c for c in documents.columns if c != "text"]
    parts = F.split(F.col("text"), r"\. ")
    split = documents.where(F.col("text") != "").select(*keep, parts.alias("_parts"))
    # A sentence starts two characters after the end of the one before it.
    starts = F.concat(
        F.array(F.lit(0)), X.running_sums(F.transform("_parts", lambda s: F.length(s) + 2))
    )
    # The starts stay beside the generator, so that they are not computed where nobody asks for them.
    rows = split.withColumn("_starts", starts).select(
        *keep, "_starts", F.posexplode_outer("_parts").alias("sent_idx", "text")
    )
    return rows.select(*keep, "sent_idx", "text", F.get("_starts", F.col("sent_idx")).alias("sent_start"))


def tokens(df: DataFrame, text: str = "text", library: bool = False, starts: bool = True) -> DataFrame:
    """One row per token: ``pos``, ``token`` and, unless not asked for, ``start``. Computed in the row, no shuffle."""
    keep = [c for c in df.columns if c != text]
    if not starts:
        tok = X.lib_tokens if library else X.ws_tokens
        rows = df.select(*keep, F.posexplode_outer(tok(F.col(text))).alias("pos", "token"))
        return rows.where(F.col("pos").isNotNull())
    placed = X.lib_tokens_placed if library else X.ws_tokens_placed
    # The start goes with its token: a list of all starts beside the generator is copied for every token.
    rows = df.select(*keep, F.posexplode_outer(placed(F.col(text))).alias("pos", "_t"))
    return rows.where(F.col("pos").isNotNull()).select(*keep, "pos", "_t.*")


def analyzed_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """Token readings: constant tag, lower-case lemma, running ``start_pos``.

    ``start_pos`` counts one separator per token, so it differs from the true
    offset where separators are longer.
    """
    keep = [c for c in df.columns if c != text]
    tok = X.ws_tokens(F.col(text))
    ends = X.running_sums(F.transform(tok, lambda t: F.length(t) + 1))
    readings = F.zip_with(
        tok,
        ends,
        lambda t, e: F.struct(
            t.alias("token"),
            F.lit("NN").alias("pos_tag"),
            F.lower(t).alias("lemma"),
            (e - F.length(t) - 1).alias("start_pos"),
        ),
    )
    return (
        df.select(*keep, F.posexplode_outer(readings).alias("pos", "_t"))
        .where(F.col("pos").isNotNull())
        .select(*keep, "pos", "_t.*")
    )


def eligible(df: DataFrame, language: str = "^en.*$", max_length: int = 1000) -> DataFrame:
    """Sentences whose language matches and that are not too long."""
    return df.where(F.col("lang").rlike(language) & (F.length("text") <= max_length))


def with_time_budget(df: DataFrame, base_ms: int = 5000, per_char_ms: int = 100) -> DataFrame:
    return df.withColumn("budget_ms", F.length("text").cast("bigint") * per_char_ms + base_ms)


def with_prompt(df: DataFrame, template: str | None = P.DEFAULT_PROMPT) -> DataFrame:
    return df.withColumn("prompt", X.render_prompt(F.col("text"), template))


def shift_offsets(matches: DataFrame, by: str | int = 0) -> DataFrame:
    """Add an offset adjustment: a constant, or a column such as ``sent_start``."""
    shift = F.lit(by) if isinstance(by, int) else F.col(by)
    return matches.withColumn("offset", F.col("offset") + shift)


def _or(column: str, default: str) -> F.Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))


def _suggestions(df: DataFrame) -> Column:
    """Suggested replacements with their defaults; from the flat columns where there is no list."""

    def filled(replacement, description, suffix, confidence):
        return F.struct(
            replacement.cast("string").alias("replacement"), F.coalesce(description, F.lit("")).alias("description"),
            F.coalesce(suffix, F.lit("")).alias("suffix"),
            F.coalesce(confidence.cast("float"), F.lit(-1).cast("float")).alias("confidence"),
        )

    none = F.array().cast("array<struct<replacement:string,description:string,suffix:string,confidence:float>>")
    if "suggested_replacements" in df.columns:
        listed = F.transform(
            "suggested_replacements", lambda r: filled(r["replacement"], r["description"], r["suffix"], r["confidence"])
        )
        return F.coalesce(listed, none)
    if "replacement" not in df.columns:
        return none
    one = filled(*[F.col(c) for c in ("replacement", "description", "suffix", "confidence")])
    return F.when(F.col("replacement").isNotNull(), F.array(one)).otherwise(none)


def wire_matches(
    matches: DataFrame, default_id: str = P.DEFAULT_RULE_ID, source_file: str = P.DEFAULT_SOURCE_FILE
) -> DataFrame:
    """Fill defaults the way the service reports a match.

    The match type is always 0 and ``auto_correct`` always true. Columns that the
    input lacks count as null. ``suggested_replacements`` is a list of (replacement,
    description, suffix, confidence), a missing confidence -1. ``rule`` stays null unless the input has one
    (``STRUCT<id, description, issue_type, category STRUCT<..>>``).
    """
    have = set(matches.columns)
    optional = {
        "id": "string", "sub_id": "string", "suggestions": "array<string>", "message": "string",
        "short_message": "string", "url": "string", "description": "string", "suffix": "string",
        "confidence": "float", "rule": None,
    }
    df = matches
    if "rule_id" in have and "id" not in have:
        df = df.withColumn("id", F.col("rule_id"))
    for name, kind in optional.items():
        if name not in df.columns and kind:
            df = df.withColumn(name, F.lit(None).cast(kind))
    message = _or("message", "")
    out = {
        "id": _or("id", default_id),
        "sub_id": _or("sub_id", ""),
        "suggestions": F.coalesce("suggestions", F.array().cast("array<string>")),
        "match_description": message,
        "match_short_description": F.coalesce(F.nullif("short_message", F.lit("")), message),
        "url": _or("url", ""),
        "replacement_description": _or("description", ""),
        "replacement_suffix": _or("suffix", ""),
        "confidence": F.coalesce(F.col("confidence"), F.lit(-1).cast("float")),
        "auto_correct": F.lit(True),
        "type": F.lit(0),
        "context_for_sure_match": F.lit(0),
    }
    if "rule" in have:
        rule = F.col("rule")
        source = F.coalesce(F.nullif(rule["id"], F.lit("")), F.lit(source_file))
        out["rule_description"] = rule["description"]
        out["rule"] = F.when(
            rule.isNotNull(),
            F.struct(
                source.alias("source_file"),
                F.coalesce(F.nullif(rule["issue_type"], F.lit("")), F.lit("style")).alias("issue_type"),
                F.lit(False).alias("temp_off"),
                F.when(
                    rule["category"].isNotNull(),
                    F.struct(
                        source.alias("id"),
                        F.coalesce(
                            F.nullif(rule["description"], F.lit("")), F.lit("Style Suggestion")
                        ).alias("name"),
                    ),
                ).alias("category"),
                F.lit(False).alias("is_premium"),
                F.array().cast("array<string>").alias("tags"),
            ),
        )
    out["suggested_replacements"] = _suggestions(df)
    drop = {"message", "short_message", "description", "suffix", "rule_id", "match_type"}
    return df.withColumns(out).drop(*(drop - set(out)))
