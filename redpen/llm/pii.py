"""Personal data and the terms that give it away. DataFrame functions only.

Base patterns find the protected values. Co-occurrence in the corpus then tells how much a
term beside them reveals about each value; terms above a threshold are found as well.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.functions.text import hold, let, running_sums
from redpen.llm.common import keep_table, packed, row_keys
from redpen.operators.skew import spread_join

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
# The contract's patterns with starts that can only fail left out, and without backtracking,
# so that long runs stay linear. Cards outside 12 to 19 digits are not even found.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEXT = 40  # characters on each side by which contexts are told apart
HINTS = {"email": "@", "phone": "+", "ip": ".", "card": ""}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# Words of letters that are no part of an address or number.
TERM = (
    r"(?<![\p{L}\p{N}@._%+-])\p{L}{3,}(?![\p{L}\p{N}@_%+-]|\.[\p{L}\p{N}])"
    rf"(?!{LOCAL}*+@[A-Za-z0-9-]++\.[A-Za-z0-9-])"
)
FILTER_WORDS = 1 << 14  # 64-bit words of the filter that drops most terms nobody asks for before a shuffle
BROADCAST_BYTES = 32 << 20  # spans of up to so many bytes are sent to every task instead of moving the texts


@dataclass(frozen=True)
class Disclosure:
    """What counts as disclosing: characters of context on each side, the share of a value's
    information content that a term must reveal, and in how many different contexts. ``sure`` is
    the share of a term's texts, one more counted, that must hold the value for the term to
    disclose it wherever it stands, and however few its contexts."""

    context: int = 120
    share: float = 0.5
    contexts: int = 3
    sure: float = 0.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"\A{OCTET}(?:\.{OCTET}){{3}}\z")
    if kind == "card":
        return F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _located(text: Column, pattern: str) -> Column:
    """Matches of a pattern with their places in code points: at, end, value, gap before, gap after."""
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern).alias("gaps")
    )

    def placed(p: Column) -> Column:
        sizes = F.zip_with(
            p["found"], F.slice(p["gaps"], 1, F.size(p["found"])), lambda v, g: F.length(v) + F.length(g)
        )
        return let(
            running_sums(sizes),
            lambda ends: F.transform(
                p["found"],
                lambda v, i: F.struct(
                    (F.get(ends, i) - F.length(v)).alias("at"), F.get(ends, i).alias("end"), v.alias("value"),
                    F.get(p["gaps"], i).alias("before"), F.get(p["gaps"], i + 1).alias("after"),
                ),
            ),
        )

    return let(parts, lambda p: F.when(F.size(p["found"]) > 0, placed(p)))


LOCATED = "array<struct<at:int,end:int,value:string,before:string,after:string>>"


def _of_kind(text: Column, number: int, kind: str, context: int) -> Column:
    matches = F.when(F.contains(text, F.lit(HINTS[kind])), _located(text, PATTERNS[kind]))
    kept = F.filter(F.coalesce(matches, F.array().cast(LOCATED)), lambda s: _valid(kind, s["value"]))
    return F.transform(
        kept,
        lambda s: F.struct(
            s["at"].alias("at"), F.lit(number).alias("kind"), s["end"].alias("end"), s["value"].alias("value"),
            F.when(
                F.length(s["before"]) > context,
                F.regexp_replace(F.right(s["before"], F.lit(context)), r"^[^\x20\x09-\x0D]+", ""),
            ).otherwise(s["before"]).alias("before"),
            F.when(
                F.length(s["after"]) > context,
                F.regexp_replace(F.left(s["after"], F.lit(context)), r"[^\x20\x09-\x0D]+$", ""),
            ).otherwise(s["after"]).alias("after"),
        ),
    )


def base_spans(text: Column, context: int) -> Column:
    """Spans of all kinds by start, then kind: at, kind (number), end, value, before, after.

    ``before`` and ``after`` are whole words within ``context`` characters up to the next
    match of the same kind.
    """
    text = F.coalesce(text, F.lit(""))
    found = [_of_kind(text, number, kind, context) for number, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*found))


def _terms(context: Column, shift: Column) -> Column:
    """Lower-case terms of a context with their places in the text."""
    located = F.coalesce(_located(context, TERM), F.array().cast(LOCATED))
    return F.transform(
        located,
        lambda s: F.struct(F.lower(s["value"]).alias("term"), (s["at"] + shift).alias("at"), (s["end"] + shift).alias("end")),
    )


def _words(text: Column) -> Column:
    """Lower-case terms of a whole text, as often as they come."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0)), F.lower)


def _slot(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(64 * FILTER_WORDS)).cast("int")


def _bit(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)))


def asked_terms(terms: DataFrame) -> DataFrame:
    """One row, ``bits``: an array of FILTER_WORDS numbers with a bit set for every term's hash. Its size is fixed."""
    slots = terms.select(_slot(F.col("term")).alias("slot"))
    words = slots.groupBy((F.shiftright("slot", 6)).cast("long").alias("id")).agg(F.bit_or(_bit(F.col("slot"))).alias("bits"))
    every = terms.sparkSession.range(FILTER_WORDS).join(words, "id", "left")
    ordered = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("all"))
    return ordered.select(F.transform("all", lambda x: x["bits"]).alias("bits"))


def _asked(term: Column, bits: Column) -> Column:
    """False for most terms that are not in the filter, never for one that is."""
    return F.get(bits, F.shiftright(_slot(term), 6)).bitwiseAND(_bit(_slot(term))) != 0


def term_counts(documents: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Occurrences of terms in all documents, and the rows that have them: term, n, rows.

    Of all terms, or of those ``among`` and some more. The null term counts all words.
    """
    own = hold(documents.select("text"), {"words": _words(F.col("text"))})
    # Lists 0, 1 and 2 of a text: all words, its different words, and one null for their number.
    lists = own.select(F.size("words").alias("size"), F.posexplode(
        F.array("words", F.array_distinct("words"), F.array(F.lit(None).cast("string")))
    ).alias("list", "terms"))
    each = lists.select("size", "list", F.explode("terms").alias("term"))
    if among is not None:
        each = each.where(F.col("term").isNull() | _asked(F.col("term"), asked_terms(among).scalar()))
    n = F.when(F.col("list") == 0, 1).when(F.col("list") == 2, F.col("size")).otherwise(0)
    return each.groupBy("term").agg(F.sum(n).alias("n"), F.sum((F.col("list") == 1).cast("int")).alias("rows"))


def disclosing_terms(occurrences: DataFrame, counts: DataFrame, rule: Disclosure) -> DataFrame:
    """Pairs of a value and a term that reveals enough of it: entity, term, share, sure.

    With P(term) over all words of the corpus and P(term | value) over the words beside the
    value, a term reveals log2 P(term | value) / P(term) bits of the value's information
    content -log2 P(value). Contexts that agree next to the value, as in copies, count once.

    A value that comes once or twice has too few contexts for that. A term is ``sure`` by the
    corpus instead: of the texts that have it, one more counted, enough have it beside the value.
    Rows of one text beside the value count once.
    """
    once = occurrences.groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
    pairs = once.groupBy("entity", "term").agg(F.count("*").alias("seen"))
    beside = pairs.groupBy("entity").agg(F.sum("seen").alias("words"))
    shown = once.groupBy("entity", "context").agg(F.lit(1).alias("one")).groupBy("entity").agg(F.sum("one").alias("shown"))
    texts = (
        occurrences.groupBy("entity", "term", "_k2").agg(F.count_distinct("_k1").alias("rows"))
        .groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("rows").alias("held"))
    )
    total = F.lit(float((counts.where("term IS NULL").agg(F.max("n")).first()[0] or 0) + 1))
    revealed = F.log2(F.col("seen") / F.col("words") * total / F.greatest("n", F.lit(1)))
    content = F.log2(total / F.col("shown"))
    all_texts = F.greatest(F.col("rows") - F.col("held") + F.col("texts"), F.col("texts"))
    zero = F.lit(0).cast("long")
    return (
        pairs.join(texts, ["entity", "term"]).join(counts, "term", "left").join(beside, "entity").join(shown, "entity")
        .withColumns({"n": F.coalesce("n", zero), "rows": F.coalesce("rows", zero)})
        .select("entity", "term", "seen", (revealed / content).alias("share"), (F.col("texts") / (all_texts + 1) >= rule.sure).alias("sure"))
        .where(F.col("sure") | ((F.col("seen") >= rule.contexts) & (F.col("share") >= rule.share))).drop("seen")
    )


def _marked(documents: DataFrame, entities: DataFrame, telling: DataFrame) -> DataFrame:
    """The places to be marked: _k1, _k2, at, end.

    Sure terms wherever they stand, the others in rows that hold their value. Values meet their
    terms first, so what a row is asked for grows with the terms of its values, not with its words.
    Of all words only those that pass the filter leave a text, and only texts with a wanted term
    are gone through for its places.
    """
    own = hold(documents.select("text", *row_keys()), {"words": F.array_distinct(_words(F.col("text")))})
    words = own.select("_k1", "_k2", F.explode("words").alias("term"))
    words = keep_table(words.where(_asked(F.col("term"), asked_terms(telling).scalar())), "words")
    sure = telling.where("sure").select("term").distinct()
    other = telling.where(~F.col("sure")).select("entity", "term")
    beside = spread_join(entities, other, ["entity"]).select("_k1", "_k2", "term").distinct()
    wanted = spread_join(words, sure, ["term"], "left_semi").select("_k1", "_k2", "term").union(
        words.join(beside, ["_k1", "_k2", "term"], "left_semi").select("_k1", "_k2", "term")
    )
    wanted = keep_table(wanted.distinct(), "wanted")
    rows = small_side(wanted.select("_k1", "_k2").distinct(), F.lit(64))
    places = documents.select("text", *row_keys()).join(rows, ["_k1", "_k2"], "left_semi").select(
        "_k1", "_k2", F.explode(_terms(F.col("text"), F.lit(0))).alias("t")
    )
    return places.select("_k1", "_k2", "t.*").join(wanted, ["_k1", "_k2", "term"], "left_semi").select("_k1", "_k2", "at", "end")


def small_side(rows: DataFrame, size: Column) -> DataFrame:
    """The rows as a table, marked for broadcast if all of them are few bytes; else the join moves both sides as usual."""
    kept = keep_table(rows, "marks")
    total = kept.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(kept) if total <= BROADCAST_BYTES else kept


def find_personal_data(documents: DataFrame, rule: Disclosure | None = None) -> DataFrame:
    """Spans of every document: doc_id, the row keys, base and spans (arrays of at, kind, end).

    ``base`` are the base kinds, ``spans`` adds kind 4, the disclosing terms: beside their
    value, elsewhere in documents that hold it, and, if they are sure, in any document.
    Places are code points.
    """
    rule = rule or Disclosure()
    held = hold(documents.select("doc_id", "text", *row_keys()), {"found": base_spans(F.col("text"), rule.context)})
    found = keep_table(held.where(F.size("found") > 0).select("_k1", "_k2", "found"), "spans").dropDuplicates(["_k1", "_k2"])

    each = found.select("_k1", "_k2", F.explode("found").alias("s")).select(
        "_k1", "_k2", F.concat_ws(":", F.col("s.kind").cast("string"), "s.value").alias("entity"),
        F.xxhash64(F.right("s.before", F.lit(NEXT)), F.left("s.after", F.lit(NEXT))).alias("context"),
        F.explode(
            F.concat(
                _terms(F.col("s.before"), F.col("s.at") - F.length("s.before")), _terms(F.col("s.after"), F.col("s.end"))
            )
        ).alias("t"),
    )
    occurrences = keep_table(each.select("_k1", "_k2", "entity", "context", "t.*"), "terms")
    counts = keep_table(term_counts(documents, occurrences.select("term")), "counts")
    telling = keep_table(disclosing_terms(occurrences, counts, rule).select("entity", "term", "sure"), "telling")
    entities = found.select("_k1", "_k2", F.explode("found").alias("s")).select(
        "_k1", "_k2", F.concat_ws(":", F.col("s.kind").cast("string"), "s.value").alias("entity")
    ).distinct()
    near = occurrences.join(telling, ["entity", "term"], "left_semi").select("_k1", "_k2", "at", "end")
    far = _marked(documents, entities, telling)
    term = F.struct("at", F.lit(len(KINDS)).alias("kind"), "end")
    terms = near.union(far).groupBy("_k1", "_k2").agg(F.collect_set(term).alias("terms"))
    none = F.array().cast("array<struct<at:int,kind:int,end:int>>")
    base = F.transform("found", lambda s: F.struct(s["at"].alias("at"), s["kind"].alias("kind"), s["end"].alias("end")))
    spans = found.select("_k1", "_k2", base.alias("base")).join(terms, ["_k1", "_k2"], "full").withColumns(
        {c: F.coalesce(c, none) for c in ("base", "terms")}
    )
    return spans.select("_k1", "_k2", "base", F.array_sort(F.concat("base", "terms")).alias("spans"))


NAMES = (*KINDS, "term")
SPAN_BYTES = "64 + 48 * size(spans)"  # of a row of spans, base ones twice


def told(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["at"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def report(documents: DataFrame, rule: Disclosure | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document.

    Null and empty texts have no spans. Repeated rows are reported as often as they come in;
    a null doc_id is kept; an empty table gives an empty result. Other columns are not read.
    """
    spans = small_side(find_personal_data(documents, rule), F.expr(SPAN_BYTES))
    rows = documents.select("doc_id", *row_keys()).join(spans, ["_k1", "_k2"], "left")
    none = F.array().cast("array<struct<at:int,kind:int,end:int>>")
    rows = rows.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("all"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        (F.size("base") - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{kind}") for n, kind in enumerate(KINDS)
    ]
    return rows.select("doc_id", *counts, F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("all")).alias("spans"))


def sanitised_text(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans are one."""
    names = F.array(*[F.lit(f"<{n.upper()}>") for n in NAMES])
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        parts = F.concat(
            acc["parts"],
            F.array(F.substring(text, acc["end"] + 1, s["at"] - acc["end"]), F.get(names, s["kind"])),
        )
        return F.struct(
            F.when(s["at"] >= acc["end"], parts).otherwise(acc["parts"]).alias("parts"),
            F.greatest(acc["end"], s["end"]).alias("end"),
        )

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["end"] + 1, F.length(text)))

    return F.aggregate(spans, start, step, finish)


def sanitise(documents: DataFrame, rule: Disclosure | None = None) -> DataFrame:
    """``documents`` with personal data and disclosing terms generalised to their kind.

    All columns stay, whatever their names, and only ``text`` changes. Rows without a span are
    left as they are, null texts too. One row per row.
    """
    spans = small_side(find_personal_data(documents, rule).select("_k1", "_k2", "spans"), F.expr(SPAN_BYTES))
    joined = packed(documents).join(spans, ["_k1", "_k2"], "left")
    changed = F.when(F.col("spans").isNull(), F.col("_row.text")).otherwise(
        sanitised_text(F.col("_row.text"), F.col("spans"))
    )
    return joined.select(
        *[(changed if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in documents.columns]
    )
