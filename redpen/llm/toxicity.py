"""Toxicity by a weighted lexicon learned from labels and matched by Aho-Corasick after folding."""

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.llm.common import slices, smallest_by_hash

# Letters of other scripts and digits or marks that are read as Latin letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "з": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ß": "b", "ı": "i", "ø": "o", "đ": "d", "ł": "i",
    "0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "l": "i",
}
SHORTEST_PREFIX, LONGEST_PREFIX = 4, 8
FEW_ROWS = 128  # texts that become Python objects at a time
MOST_HELD = 50_000  # pairs or counted strings of one task before they are handed on


class _Folding(dict):
    """The table, and letters outside it by their decomposition in lower case; marks and signs as blanks."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if not 0x300 <= ord(c) < 0x370)
        parts = [self[ord(c)] if ord(c) in self else " " if unicodedata.category(c)[0] in "PSZ" else c
                 for c in unicodedata.normalize("NFC", plain).casefold()]
        self[code] = folded = "".join(p for p in parts if p)
        return folded


def _folding() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for code in range(0x250):
        ch = chr(code)
        base = unicodedata.normalize("NFKD", ch)[0].lower()
        table[code] = base if base.isalnum() else " "
    for code in range(0xFF01, 0xFF5F):
        table[code] = table[code - 0xFEE0]
    table.update(dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD, *range(0x300, 0x370)]))
    table.update({code: " " for code in [*range(0x2000, 0x200B), *range(0x2010, 0x2060), 0x3000]})
    for ch, latin in LOOKALIKES.items():
        for form in (ch, ch.upper()):
            if len(form) == 1:
                table[ord(form)] = latin
    return _Folding({code: LOOKALIKES.get(ch, ch) if ch else None for code, ch in table.items()})


FOLDING = _folding()


def fold(text: str | None) -> str:
    """Lower-case letters without accents, lookalikes and digits read as Latin letters, marks as blanks.

    Styled, circled and full-width letters are read as the plain ones, capitals of any script as small.

    ``l``, ``1`` and ``i`` are one letter, so every reading of a 1 is found. Blanks at both ends.
    """
    return f" {(text or '').translate(FOLDING)} "


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_terms(word: str) -> list[str]:
    """The whole word and its beginnings as terms; blanks stand for word ends."""
    longest = min(LONGEST_PREFIX, len(word) - 1)
    return [f" {word} ", *[f" {word[:n]}" for n in range(SHORTEST_PREFIX, longest + 1)]]


@dataclass(frozen=True)
class Lexicon:
    """Weights of terms, exception phrases, and the logistic model over a text's matches."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    model: tuple[float, ...]

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight, term))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None, phrase))
        if len(found):
            found.make_automaton()
        return found


def matches(folded: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, float, str]]:
    """Start, end, weight and term of all lexicon matches outside exception phrases.

    Of the terms that match at one word only the heaviest counts.
    """
    if not len(automaton):
        return []
    hits, free = {}, []
    for last, (size, weight, term) in automaton.iter(folded):
        start = last + 1 - size
        if weight is None:
            free.append((start, last + 1))
        elif start not in hits or hits[start][2] < weight:
            hits[start] = (start, last + 1, weight, term)
    free.sort()
    found, i, reach = [], 0, -1
    for start in sorted(hits):
        while i < len(free) and free[i][0] <= start:
            reach = max(reach, free[i][1])
            i += 1
        if reach < hits[start][1]:
            found.append(hits[start])
    return found


def features(folded: str, automaton: ahocorasick.Automaton) -> tuple[float, ...]:
    """Constant, any match, weight in all, weight per root of the length, length."""
    found = matches(folded, automaton)
    weight, size = sum(m[2] for m in found), folded.count(" ")
    return (1.0, float(bool(found)), float(np.log1p(weight)), weight / (size + 10) ** 0.5, float(np.log1p(size)))


def fit_logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 0.01) -> tuple[float, ...]:
    """Logistic regression by Newton steps; the prior rate where all labels agree."""
    beta = np.zeros(rows.shape[1] if rows.ndim == 2 else 5)
    if not len(labels) or labels.min() == labels.max():
        rate = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.05
        beta[0] = np.log(rate / (1 - rate))
        return tuple(beta)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        slope = rows.T @ (labels - p) - ridge * beta
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a term and the word before it, handed on at MOST_HELD, also within a long text."""

    def handed(seen):
        terms, before = zip(*seen, strict=True) if seen else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(before, pa.string())], names=["term", "before"])

    seen = set()
    for batch in slices(batches, FEW_ROWS):
        for text in batch.column(0).to_pylist():
            ws = fold(text).split()
            for before, word in zip(["", *ws], ws, strict=False):
                seen.update((term, before) for term in word_terms(word))
                if len(seen) >= MOST_HELD:
                    yield handed(seen)
                    seen = set()
    yield handed(seen)


def _toxic_evidence(sample: DataFrame, least: int) -> DataFrame:
    """Terms of toxic texts with the number of different words they follow, so that copies count once."""
    pairs = sample.where("toxic = 1").select("text").mapInArrow(_evidence, "term string, before string").distinct()
    return pairs.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _counted(sample: DataFrame, found_in, name: str) -> DataFrame:
    """Number of clean and of toxic texts in which ``found_in`` finds each string."""

    def handed(counts):
        keys = sorted({*counts[0], *counts[1]})
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in counts]],
            names=[name, "clean", "toxic"],
        )

    def run(batches):
        counts = (Counter(), Counter())
        for batch in slices(batches, FEW_ROWS):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update(found_in(fold(text)))
                if len(counts[0]) + len(counts[1]) >= MOST_HELD:
                    yield handed(counts)
                    counts = (Counter(), Counter())
        yield handed(counts)

    mapped = sample.select("text", "toxic").mapInArrow(run, f"{name} string, clean long, toxic long")
    return mapped.groupBy(name).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _most_telling(heavy: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Of terms (weight, toxic texts) that begin alike, the ones to keep.

    A beginning gives way to an extension found in nine tenths of its texts; an extension
    that weighs hardly more than a beginning kept is left out.
    """
    extended = Counter()
    for term, (_, texts) in heavy.items():
        for n in range(SHORTEST_PREFIX + 1, len(term)):
            extended[term[:n]] = max(extended[term[:n]], texts)
    kept: dict[str, float] = {}
    for term in sorted(heavy, key=lambda t: (len(t), t)):
        weight, texts = heavy[term]
        shorter = (kept.get(term[:n], -1.0) for n in range(SHORTEST_PREFIX + 1, len(term)))
        if extended[term] < 0.9 * texts and max(shorter, default=-1.0) < weight - 0.5:
            kept[term] = weight
    return kept


def learn_lexicon(
    documents: DataFrame, labels: DataFrame, label_bound: int = 20_000, least_evidence: int = 5,
    least_weight: float = 3.0, most_terms: int = 5_000, exceptions: tuple[str, ...] = (),
) -> Lexicon:
    """Lexicon, exception phrases and model from at most ``label_bound`` labelled documents.

    The labelled rows are those with the smallest hash of their id, held-out rows left out. A
    term needs ``least_evidence`` different words before it in toxic texts, and log odds of
    ``least_weight`` against clean texts; of these the ``most_terms`` heaviest are the lexicon.
    Phrases of two words around a match that occur in three clean texts and in no toxic one
    are exceptions, beside the ones given. Only these bounded results reach the driver.
    """
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")
    )
    chosen = known.join(F.broadcast(smallest_by_hash(known, "doc_id", label_bound)), "doc_id", "left_semi")
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)

    evidence = {
        r.term: r.n for r in _toxic_evidence(sample, least_evidence).orderBy(F.desc("n"), "term").limit(200_000).collect()
    }
    wanted = frozenset(evidence)

    def terms_of(folded):
        return {t for w in set(folded.split()) for t in word_terms(w)} & wanted

    heavy = {}
    for row in _counted(sample, terms_of, "term").collect():
        odds = float(np.log((row.toxic + 0.5) / (toxic + 1)) - np.log((row.clean + 0.5) / (clean + 1)))
        if odds >= least_weight:
            heavy[row.term] = (odds, row.toxic)
    weights = _most_telling(heavy)
    weights = dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:most_terms])

    given = tuple(f" {' '.join(fold(p).split())} " for p in exceptions)
    plain = Lexicon(weights, (), ())
    built = {}  # one automaton per Python worker and lexicon

    def phrases(folded):
        if not built:
            built["automaton"] = plain.automaton()
        ws = f" {' '.join(folded.split())} "
        found = set()
        for start, _, _, _ in matches(ws, built["automaton"]):
            end = ws.find(" ", start + 1)
            after = ws.find(" ", end + 1)
            before = ws.rfind(" ", 0, start) if start else -1
            found.update([ws[start : after + 1]] if after > 0 else [])
            found.update([ws[before : end + 1]] if before >= 0 else [])
        return found

    learned = [r.phrase for r in _counted(sample, phrases, "phrase").where("clean >= 3 AND toxic = 0").collect()]
    lexicon = Lexicon(weights, tuple(sorted({*given, *learned})), ())

    def measured(batches):
        automaton = lexicon.automaton()
        for batch in slices(batches, FEW_ROWS):
            rows = [features(fold(t), automaton) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"]
            )

    points = sample.select("text", "toxic").mapInArrow(measured, "x array<double>, toxic int").collect()
    model = fit_logistic(np.array([p.x for p in points]), np.array([p.toxic for p in points], float))
    return Lexicon(weights, lexicon.exceptions, model)


def score_toxicity(documents: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, and the matched terms of every document.

    The score depends on the text alone: lexicon matches on the folded text outside exception
    phrases, normalised by its length. Null and empty texts have no match and get the score of
    a text without words. Every row is scored once, repeated ones alike; a null doc_id is
    kept; an empty table gives an empty result. Other columns are not read.
    """
    beta = np.array(lexicon.model)

    def run(batches):
        automaton = lexicon.automaton()
        for batch in slices(batches, FEW_ROWS):
            scores, terms = [], []
            for text in batch.column(1).to_pylist():
                folded = fold(text)
                x = np.array(features(folded, automaton))
                scores.append(float(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))))
                terms.append(sorted({m[3].strip() for m in matches(folded, automaton)}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(terms, pa.list_(pa.string()))],
                names=["doc_id", "score", "terms"],
            )

    scored = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double, terms array<string>"
    )
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "terms",
    )


def drop_toxic(documents: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """``documents`` without those that score at the threshold or above. All columns stay, whatever their names.

    Null and empty texts get the score of a text without words, repeated rows the same one; very
    long texts are scored whole; an empty table stays empty.
    """
    beta = np.array(lexicon.model)

    @F.arrow_udf("boolean")
    def mild(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = lexicon.automaton()
        for batch in texts:  # one text at a time is a Python object
            x = np.array([features(fold(t.as_py()), automaton) for t in batch]).reshape(-1, len(beta))
            yield pa.array(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))) < threshold)

    return documents.where(mild(F.col("text").cast("string")))
