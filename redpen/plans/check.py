"""The main path: sentences in, merged matches out."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.functions.text import hold
from redpen.operators import correctors as C
from redpen.operators import edits as E
from redpen.operators import fanout, merge, project

MATCH_DDL = (
    "array<struct<offset:int,length:int,replacement:string,description:string,"
    "message:string,rule_id:string,match_type:int,corrector_idx:int,match_idx:int>>"
)
ERROR_DDL = "array<struct<corrector_idx:int,rule_id:string,error:string>>"


def _numbered(corrector_idx: int):
    return lambda m, i: m.withField("corrector_idx", F.lit(corrector_idx)).withField("match_idx", i)


def match_texts(
    texts: DataFrame, correctors: list[C.Corrector], text: str = "text", batch: bool = True
) -> DataFrame:
    """Add ``matches``, merged over the correctors, to a table of texts.

    All correctors of a text work in its row, so fan-out and merge need no
    shuffle. A corrector that fails on a text adds no match for it, but an entry
    in ``errors``, so that "nothing found" and "failed" differ.
    """
    df = texts
    for idx, corrector in enumerate(correctors):
        df = C.rewrite(df, corrector, text, "corrected")
        # A failed text is diffed against itself, which gives no edits.
        df = df.withColumns(
            {"original": F.col(text), "corrected": F.coalesce("corrected", F.col(text))}
        )
        df = E.with_typed_matches(df, corrector.effective_rule_id, corrector.min_length)
        numbered = F.transform("matches", _numbered(idx))
        failed = F.when(
            F.col("error").isNotNull(),
            F.struct(
                F.lit(idx).alias("corrector_idx"), F.lit(corrector.effective_rule_id).alias("rule_id"),
                F.col("error").cast("string").alias("error"),
            ),
        )
        df = df.withColumns({f"_m{idx}": numbered.cast(MATCH_DDL), f"_e{idx}": failed}).drop(
            "matches", "corrected", "original", "error"
        )
    each = [F.col(f"_m{i}") for i in range(len(correctors))]
    together: Column = F.concat(*each) if each else F.array().cast(MATCH_DDL)
    failures = F.array(*[F.col(f"_e{i}") for i in range(len(correctors))]).cast(ERROR_DDL)
    found = {"matches": merge.merge_arrays(together), "errors": F.filter(failures, lambda e: e.isNotNull())}
    return hold(df, found).drop(*[f"_{k}{i}" for i in range(len(correctors)) for k in "me"])


def check_sentences(
    sentences: DataFrame,
    correctors: list[C.Corrector],
    once: bool | None = None,
    language: str | None = None,
    max_length: int | None = None,
) -> DataFrame:
    """One row per sentence with its ordered, merged match list and its errors.

    ``language`` (a pattern) and ``max_length`` restrict what is checked; by default nothing
    does. Sentences outside them stay, with empty lists.

    ``once`` computes each distinct text one time. That costs a shuffle of the texts, which
    pays for models only; by default it is done if a corrector has a batch function.
    """
    if once is None:
        once = any(c.batch_function for c in correctors)
    run = (lambda t: fanout.once_per_text(t, lambda x: match_texts(x, correctors))) if once else (
        lambda t: match_texts(t, correctors)
    )
    if language is None and max_length is None:
        return run(sentences)
    wanted = F.lit(True)
    if language is not None:
        wanted = wanted & F.coalesce(F.col("lang").rlike(language), F.lit(False))
    if max_length is not None:
        wanted = wanted & (F.coalesce(F.length("text"), F.lit(0)) <= max_length)
    nothing = {"matches": F.array().cast(MATCH_DDL), "errors": F.array().cast(ERROR_DDL)}
    return run(sentences.where(wanted)).unionByName(sentences.where(~wanted).withColumns(nothing))


def check_documents(documents: DataFrame, correctors: list[C.Corrector], **options) -> DataFrame:
    """Analyze, then process: the flat list of matches of each document.

    Offsets stay relative to the sentence; ``doc_offset`` adds the sentence start.
    """
    checked = check_sentences(project.sentences(documents), correctors, **options)
    flat = merge.flatten_results(checked, ["doc_id", "sent_idx", "sent_start"])
    return flat.withColumn("doc_offset", F.col("offset") + F.col("sent_start"))
