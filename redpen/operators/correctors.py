"""Correctors: rule tables, user functions, and edit tags."""

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redpen.functions import patterns as P
from redpen.functions import text as X

# A user function factory: called once per task, returns texts -> rewritten texts.
BatchFunction = Callable[[], Callable[[list[str]], list[str]]]


@dataclass(frozen=True)
class Corrector:
    """One corrector of the registry: a rule table or a user function."""

    name: str
    kind: str = "text2text"
    rule_id: str | None = None
    prompt_template: str | None = None
    min_length: int = 1
    rules: list[tuple[str, str]] = field(default_factory=list)
    batch_function: BatchFunction | None = None
    batch_size: int = 8

    def __post_init__(self) -> None:
        if self.kind not in P.CORRECTOR_KINDS:
            raise ValueError(f"Unknown corrector kind for {self.name}: {self.kind}")

    @property
    def effective_rule_id(self) -> str:
        return self.rule_id or self.name

    @property
    def template(self) -> str | None:
        """The coedit kind has a prompt of its own."""
        if self.prompt_template is None and self.kind == "coedit":
            return P.DEFAULT_PROMPT
        return self.prompt_template


def registry_columns(correctors: list[Corrector]) -> Column:
    """The registry as an array of structs, in corrector order."""
    return F.array(
        *[
            F.struct(
                F.lit(c.name).alias("name"),
                F.lit(c.kind).alias("kind"),
                F.lit(c.effective_rule_id).alias("rule_id"),
                F.lit(c.template).cast("string").alias("prompt_template"),
                F.lit(max(1, c.min_length)).alias("min_length"),
            )
            for c in correctors
        ]
    )


def apply_rules(text: Column, rules: list[tuple]) -> Column:
    """Ordered table of (pattern, replacement); ``$1`` refers to a group.

    A third entry names a string without which the pattern cannot match; looking
    for it first saves most of the pattern work.
    """
    for pattern, replacement, *needed in rules:
        if needed:
            text = X.let(text, X.replace_where([needed[0]], pattern, replacement))
        else:
            text = F.regexp_replace(text, pattern, replacement)
    return text


def rewrite_batches(
    df: DataFrame,
    function: BatchFunction,
    prompt: str = "prompt",
    text: str = "text",
    out: str = "corrected",
    batch_size: int = 8,
) -> DataFrame:
    """Rewrite texts with a user function in batches of ``batch_size``.

    The factory runs once per task. An empty output means the original text. When
    a batch fails its texts are tried one by one, and the message of a text that
    still fails goes to the ``error`` column.
    """
    result = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        predict = function()

        def attempt(texts):
            new = list(predict(texts))
            if len(new) != len(texts):
                raise ValueError(f"{len(texts)} texts in, {len(new)} out")
            return [(n, None) for n in new]

        def guarded(texts):
            try:
                return attempt(texts)
            except Exception as failure:
                if len(texts) == 1:
                    return [(None, repr(failure))]
                return [pair for t in texts for pair in guarded([t])]

        kind = pa.struct([("text", pa.string()), ("error", pa.string())])
        for prompts, originals in batches:
            asked, old = prompts.to_pylist(), originals.to_pylist()
            rows = []
            for at in range(0, len(asked), batch_size):
                rows += guarded(asked[at : at + batch_size])
            yield pa.array(
                [
                    {"text": new or (None if error else before), "error": error}
                    for (new, error), before in zip(rows, old)
                ],
                type=kind,
            )

    # Annotations tell Spark which form of Arrow function this is.
    run.__annotations__ = {
        "batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array],
    }
    rewrite = F.arrow_udf(run, result)
    df = df.withColumn("_r", rewrite(F.col(prompt), F.col(text)))
    return df.withColumns({out: F.col("_r.text"), "error": F.col("_r.error")}).drop("_r")


def rewrite(df: DataFrame, corrector: Corrector, text: str = "text", out: str = "corrected") -> DataFrame:
    """Prompt, then rewrite, by whichever way the corrector has."""
    if corrector.batch_function is None:
        return df.withColumns(
            {out: apply_rules(F.col(text), corrector.rules), "error": F.lit(None).cast("string")}
        )
    prompted = df.withColumn("_prompt", X.render_prompt(F.col(text), corrector.template))
    return rewrite_batches(
        prompted, corrector.batch_function, "_prompt", text, out, corrector.batch_size
    ).drop("_prompt")


def tags_by_sentence(tags: DataFrame, keys: list[str], keep_confidence: float = 0.0) -> DataFrame:
    """Per sentence, the winning tag of each (pass, position) and its error probability.

    One shuffle by sentence serves both steps. A sentence has at most one winner
    per token and pass, so the list is bounded by its length.
    """
    keep = F.col("tag") == "$KEEP"
    score = F.col("prob") + F.when(keep, keep_confidence).otherwise(0.0)
    best = (
        tags.repartition(*keys)
        .groupBy(*keys, "pass_no", "pos")
        .agg(F.max(F.struct(score.alias("s"), keep.alias("k"), "tag")).alias("b"), F.max("p_error").alias("p_error"))
    )
    return best.groupBy(*keys).agg(
        F.collect_list(F.struct("pass_no", "pos", F.col("b.tag").alias("tag"), "p_error")).alias("_tags")
    )


def _of_pass(number: int):
    return lambda t: t.pass_no == number


def _edited(token: Column, pos: Column) -> Column:
    tag = F.try_element_at("_mine", pos)
    rest = F.when(F.startswith(tag, F.lit("$REPLACE_")), F.substring(tag, F.lit(10), F.length(tag))).otherwise(
        F.substring(tag, F.lit(9), F.length(tag))
    )
    return (
        F.when(tag == "$DELETE", F.array().cast("array<string>"))
        .when(F.startswith(tag, F.lit("$REPLACE_")), F.array(rest))
        .when(F.startswith(tag, F.lit("$APPEND_")), F.array(token, rest))
        .otherwise(F.array(token))
    )


def apply_tags(
    sentences: DataFrame,
    tags: DataFrame,
    keys: list[str],
    keep_confidence: float = 0.0,
    min_error_prob: float = 0.0,
    n_iteration: int = 5,
    text: str = "text",
    out: str = "corrected",
) -> DataFrame:
    """Apply edit tags ``$KEEP``, ``$DELETE``, ``$REPLACE_w``, ``$APPEND_w`` in passes.

    Per pass and token the tag with the highest probability wins, ``$KEEP`` with
    a bonus of ``keep_confidence``. A pass whose largest error probability is
    below ``min_error_prob`` changes nothing. All passes run inside the row after
    one join.
    """
    nested = tags_by_sentence(tags.where(F.col("pass_no") <= n_iteration), keys, keep_confidence)
    df = sentences.join(nested, keys, "left").withColumn("_tok", X.ws_tokens(F.col(text)))
    for number in range(1, n_iteration + 1):
        df = df.withColumn("_now", F.filter("_tags", _of_pass(number)))
        changes = F.filter("_now", lambda t: t.tag != "$KEEP")
        entries = F.transform(changes, lambda t: F.struct(t.pos, t.tag))
        sure = F.array_max(F.transform("_now", lambda t: t.p_error)) >= min_error_prob
        df = df.withColumn("_mine", F.when(sure, F.map_from_entries(entries)))
        df = df.withColumn(
            "_tok",
            F.when(F.col("_mine").isNull() | (F.size("_mine") == 0), F.col("_tok")).otherwise(
                F.flatten(F.transform("_tok", _edited))
            ),
        )
    return df.withColumn(out, F.array_join("_tok", " ")).drop("_tok", "_tags", "_mine", "_now")
