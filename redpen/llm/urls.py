"""URL rules by hashed host-suffix and path-prefix expressions. DataFrame functions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.llm.common import ascii_lower

PREFIX_HEX = 8  # short hash prefixes of four bytes


def url_host(url: Column) -> Column:
    """Host after the first ``://``, A-Z lower-cased; empty for null or without ``://``."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _boundaries(path: Column) -> Column:
    """Lengths of the path prefixes that end in a slash, and 0 for the empty prefix."""
    parts = F.split(path, "/")
    sizes = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.length(p) + 1)
    return F.aggregate(
        sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    )


def _suffixes(host: Column, labels: Column) -> Column:
    """Host suffixes with at most ``labels`` labels; one empty suffix for an empty host."""
    parts = F.split(host, r"\.")
    least = F.greatest(F.lit(0), F.size(parts) - F.greatest(labels, F.lit(1)))
    return F.transform(
        F.sequence(least, F.size(parts) - 1),
        lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."),
    )


def _up_to_slash(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Rules with the full digest of host and path, and the short hash of host and path up to its last slash."""
    host, path = ascii_lower(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))
    return (
        rules.select(host.alias("rule_host"), path.alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .where(F.col("rule_verdict").isNotNull()).distinct()
        .select(
            "*",
            F.left(F.sha2(F.concat_ws("\n", "rule_host", _up_to_slash(F.col("rule_path"))), 256), F.lit(PREFIX_HEX))
            .alias("short_hash"),
            F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256).alias("digest"),
        )
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Verdict of every page's URL: page_id, url, host, path, rule, verdict.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the
    URL's path starts with the rule's. The longest fitting rule (host and path together)
    wins, then the longer host, then block. URLs that no rule fits get ``default``.

    Each URL is expanded to (host suffix, path prefix up to a slash). Their short hashes
    meet those of the rules in an equi-join, then the full digest of the rule's own
    lengths is compared. Suffixes and prefixes beyond the longest rule cannot match and
    are not made. The small side is broadcast only if Spark knows it is small; else the
    join shuffles, and adaptive execution splits hot hosts.

    A null URL, or one without ``://``, has an empty host and path. Repeated rows are
    returned as often as they come in. A null page_id is kept. An empty table gives an
    empty result, no rules give ``default`` for all. Other columns are not read.
    """
    rules = prepared_rules(rules)
    deepest = rules.agg(
        F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(0)).alias("labels"),
        F.coalesce(F.max(F.length(_up_to_slash(F.col("rule_path")))), F.lit(0)).alias("chars"),
    ).first()
    parsed = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    reach = F.left(F.col("path"), F.lit(deepest.chars))
    expressions = F.flatten(
        F.transform(
            _suffixes(F.col("host"), F.lit(deepest.labels)),
            lambda suffix: F.transform(
                _boundaries(reach),
                lambda n: F.struct(
                    suffix.alias("suffix"),
                    F.left(
                        F.sha2(F.concat(suffix, F.lit("\n"), F.left(reach, n)), 256), F.lit(PREFIX_HEX)
                    ).alias("short_hash"),
                ),
            ),
        )
    )
    # One entry without a hash counts the row itself, so that pages without a match stay.
    own = F.struct(F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("string").alias("short_hash"))
    expanded = parsed.select("*", F.explode(F.concat(F.array(own), expressions)).alias("e")).select(
        "page_id", "url", "host", "path", "e.suffix", "e.short_hash"
    )
    met = expanded.join(rules, "short_hash", "left")
    same_digest = F.sha2(
        F.concat(F.col("suffix"), F.lit("\n"), F.left(F.col("path"), F.length("rule_path"))), 256
    ) == F.col("digest")
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"),
        F.length("rule_host").alias("host_size"),
        (F.col("rule_verdict") == "block").alias("blocks"),
        "rule_host", "rule_path", "rule_verdict",
    )
    best = met.groupBy("page_id", "url", "host", "path").agg(
        F.max(F.when(same_digest, rank)).alias("best"),
        F.count(F.when(F.col("short_hash").isNull(), 1)).alias("copies"),
    )
    return best.select(
        "page_id", "url", "host", "path",
        F.concat("best.rule_host", "best.rule_path").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
