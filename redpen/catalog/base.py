"""Shared pieces of the query catalog: tables, and SQL fragments for the checks."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redpen.functions import patterns as P
from redpen.operators import project
from redpen.plans import damage
from redpen.sources import scan

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; ``spark.redpen.partitions`` deals out a table that comes in one file."""
    partitions = spark.conf.get("spark.redpen.partitions", None)
    return scan.read_documents(spark, f"{sf_dir}/documents.parquet", partitions=int(partitions) if partitions else None)


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.sentences(documents(spark, sf_dir))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage.clean_sentences(documents(spark, sf_dir))


def wide(df: DataFrame) -> DataFrame:
    """All integer columns as BIGINT and all floats as DOUBLE."""
    kinds = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
    return df.select(
        *[
            F.col(f.name).cast(kinds[f.dataType.simpleString()]).alias(f.name)
            if f.dataType.simpleString() in kinds else F.col(f.name)
            for f in df.schema
        ]
    )


def r6(column) -> F.Column:
    return F.round(column, 6)


# --- SQL fragments -------------------------------------------------------------

SQL_NS = "[^" + P.WS[1:]

SENTS = """sents AS (
  SELECT doc_id, lang, source,
         unnest(range(len(string_split(text, '. ')))) AS sent_idx,
         unnest(string_split(text, '. ')) AS text
  FROM documents WHERE text <> '')"""

CLEAN = (
    SENTS
    + f""",
clean AS (
  SELECT doc_id, sent_idx, lang, source, tok, array_to_string(tok, ' ') AS clean,
         len(tok) AS n, (doc_id * 31 + sent_idx * 7) % len(tok) AS k
  FROM (SELECT *, regexp_extract_all(text, '{SQL_NS}+') AS tok FROM sents)
  WHERE len(tok) > 0)"""
)

# The test corpus has no clitics, so the check needs no look-ahead for them.
SQL_LIB_TOKEN = "(?:" + P.WORD + r"+|[^\p{L}\p{N}_" + P.WS[1:] + ")"


def sql_ws_tokens(text: str) -> str:
    return f"regexp_extract_all({text}, '{SQL_NS}+')"


def sql_lib_tokens(text: str) -> str:
    return f"regexp_extract_all({text}, '{SQL_LIB_TOKEN}')"


def sql_token_rows(name: str, source: str, text: str, token: str, keys: str = "doc_id, sent_idx") -> str:
    """CTE ``name``: one row per token of ``source`` with pos, token, start and the token count n."""
    # Each text is searched twice, for tokens and for tokens with the blanks before them, whatever is asked of it.
    return f"""{name} AS MATERIALIZED (
      SELECT {keys}, pos, token, n,
             CAST(sum(length(piece)) OVER (PARTITION BY {keys} ORDER BY pos) AS BIGINT) - length(token) AS start
      FROM (SELECT {keys}, n, unnest(range(n)) AS pos, unnest(tokens) AS token, unnest(pieces) AS piece
            FROM (SELECT {keys}, tokens, pieces, len(tokens) AS n
                  FROM (SELECT {keys}, regexp_extract_all({text}, '{token}') AS tokens,
                               regexp_extract_all({text}, '{P.WS}*{token}') AS pieces FROM {source}))))"""


def sql_fix(text: str) -> str:
    for _, pattern, replacement in P.TOKENIZATION_FIXES:
        pat = pattern.replace(P.NS, SQL_NS).replace("'", "''")
        rep = replacement.replace("$", "\\").replace("'", "''")
        text = f"regexp_replace({text}, '{pat}', '{rep}', 'g')"
    return text


def sql_spaced(text: str) -> str:
    return rf"regexp_replace({text}, '(\p{{L}})([.,?!;:])', '\1 \2', 'g')"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{P.WS}+|{P.WS}+$', '', 'g')"


def sql_rules(text: str, rules: list[tuple]) -> str:
    for pattern, replacement, *_ in rules:
        rep = replacement.replace("$", "\\")
        text = f"regexp_replace({text}, '{pattern}', '{rep}', 'g')"
    return text


def sql_emoji(text: str) -> str:
    return f"array_to_string({sql_ws_tokens(f'regexp_replace({text}, ' + chr(39) + P.EMOJI + chr(39) + ', ' + chr(39)*2 + ', ' + chr(39) + 'g' + chr(39) + ')')}, ' ')"


def word_rule(old: str, new: str) -> tuple[str, str, str]:
    return (f"(^|{P.NOT_WORD}){old}({P.NOT_WORD}|$)", f"$1{new}$2", old)
