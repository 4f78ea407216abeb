"""Spelling variants: words one edit apart, found by walking a trie that is a table."""

import re
import zlib
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpen.llm.common import UPPER, keep_table, slices

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {ord(c): c.lower() for c in UPPER}
FEW_ROWS = 256  # rows that become Python objects at a time
MOST_WORDS, MOST_CHARS = 200_000, 16_000_000  # counted words of one task before they are handed on
MOST_NODES = 50_000  # nodes of one batch
SLOTS = 64  # bits of ``soon``


def misspelt(doc_id: int | None, run: str, share: int) -> str:
    """The run, or, for one in ``share`` of all runs, the run without the code point that its checksum names."""
    checksum = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if checksum % share:
        return run
    at = checksum % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(documents: DataFrame, share: int, shortest: int) -> DataFrame:
    """word and n, the occurrences of every word of at least ``shortest`` code points in all documents."""

    def out(counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    def run(batches):
        counts, chars = Counter(), 0
        for batch in slices(batches, FEW_ROWS):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for found, n in Counter(RUN.findall(text or "")).items():
                    if len(found) < shortest:
                        continue
                    low = found.lower() if found.isascii() else found.translate(LOWER)
                    word = misspelt(doc_id, low, share)
                    if len(word) >= shortest:
                        chars += 0 if word in counts else len(word)
                        counts[word] += n
                if len(counts) > MOST_WORDS or chars > MOST_CHARS:
                    yield out(counts)
                    counts, chars = Counter(), 0
        if counts:
            yield out(counts)

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def spellings(words: DataFrame) -> DataFrame:
    """word, n, lead, spelling, id: every word forwards and, after a mark that no word has, backwards."""
    sides = words.select("word", "n", F.inline(F.array(
        F.struct(F.lit("").alias("lead"), F.col("word").alias("spelling")),
        F.struct(F.lit("<").alias("lead"), F.reverse("word").alias("spelling")),
    )))
    return sides.withColumn("id", F.xxhash64(F.concat("lead", "spelling")))


def prefixes(sides: DataFrame) -> DataFrame:
    """The nodes of every spelling from just below its middle on: id, depth, node, char.

    A node is the digest of a prefix, ``id`` the node of the whole spelling, ``char`` the
    character that follows, empty at the end. One edit leaves half of a word or of its reverse
    untouched, so no node above the middle is needed, and none that very many words share.
    """

    def out(rows):
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "depth", "node", "char"]
        )

    def run(batches):
        rows = []
        for batch in slices(batches, FEW_ROWS):
            for lead, spelling, whole in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                start = (len(spelling) - 1) // 2
                state = xxhash.xxh64((lead + spelling[:start]).encode(), 42)
                for depth in range(start, len(spelling) + 1):
                    char = spelling[depth : depth + 1]
                    rows.append((whole, depth, _signed(state.intdigest()), char))
                    state.update(char.encode())
                    if len(rows) >= MOST_NODES:
                        yield out(rows)
                        rows = []
        if rows:
            yield out(rows)

    return sides.select("lead", "spelling", "id").mapInArrow(run, "id long, depth int, node long, char string")


def _slot(rest: Column) -> Column:
    """One of 64 slots for what follows a node: the next two characters together with how many are left."""
    return F.pmod(F.xxhash64(F.substring(rest, 1, 2), F.length(rest)), F.lit(SLOTS)).cast("int")


def _open(slot: Column) -> Column:
    """Whether the child of an edge may be followed by what has the slot."""
    return F.call_function("shiftright", F.col("soon"), slot).bitwiseAND(F.lit(1)) == 1


def trie(sides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words' places in the trie, and its edges.

    Places: word, node, rest, ends, one for each branching or ending node of a spelling not above
    its middle; ``rest`` is what follows the node. Edges: node, first, label, child, soon, from one
    such node to the next below; ``label`` is what is spelt between, ``first`` the code of its
    first character. ``soon`` has a bit for all that follows the child (see ``_slot``): a state
    whose rest has no bit there cannot end at a word. A node that very many words share is split
    by adaptive execution; it has no more edges than the alphabet has letters.
    """
    own = keep_table(prefixes(sides), "prefixes")
    kept = own.groupBy("node").agg(F.min("char").alias("least"), F.max("char").alias("most")).where(
        "least < most OR least = ''"
    ).select("node", (F.col("least") == "").alias("ends"))
    path = own.select("id", "depth", "node").join(kept, "node").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("depth", "node", "ends"))).alias("path")
    )
    walked = keep_table(sides.select("id", "word", "spelling").join(path, "id"), "paths")

    size = F.length("spelling")
    place = walked.select("word", "spelling", F.inline("path")).where(F.col("depth") >= F.floor(size / 2))
    places = place.select("word", "node", F.col("spelling").substr(F.col("depth") + 1, size).alias("rest"), "ends")

    def edge(here: Column, below: Column) -> Column:
        label = F.col("spelling").substr(here["depth"] + 1, below["depth"] - here["depth"])
        after = F.col("spelling").substr(below["depth"] + 1, size)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), _slot(after))
        return F.struct(here["node"].alias("node"), label.alias("label"), below["node"].alias("child"), bit.alias("soon"))

    steps = F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path")), edge)
    edges = walked.select("spelling", "path").where(F.size("path") > 1).select(F.inline(steps)).groupBy(
        "node", F.ascii("label").alias("first")
    ).agg(F.min("label").alias("label"), F.min("child").alias("child"), F.bit_or("soon").alias("soon"))
    return places, edges


def _after_one_edit(places: DataFrame, edges: DataFrame) -> DataFrame:
    """States word, node, rest after one edit at a place and the edge behind it, which leaves the word's own path.

    The edge's first character replaces the word's or comes before it, and its other characters
    follow unchanged; or the word's is left out, and the edge follows. Most labels are one
    character: what is asked for those is computed once per place.
    """
    rest = F.col("rest")

    def after(n: int) -> Column:
        return rest.substr(F.lit(n + 1), F.length(rest))

    ready = places.select("word", "node", "rest", F.ascii(rest).alias("_c0"), F.ascii(after(1)).alias("_c1"), *[
        _slot(after(n)).alias(f"_s{n}") for n in range(3)
    ])
    met = ready.join(edges, "node").where(F.col("first") != F.col("_c0"))
    size, tail = F.length("label"), F.col("label").substr(F.lit(2), F.length("label"))

    def way(fits: Column, slot: str, long_fits: Column, behind: Column) -> tuple[Column, Column]:
        left = rest.substr(behind + 1, F.length(rest))
        return F.when(size == 1, fits & _open(F.col(slot))).otherwise(long_fits & _open(_slot(left))), left

    some = rest != ""
    ways = [
        way(some, "_s1", some & (rest.substr(F.lit(2), size - 1) == tail), size),
        way(F.lit(True), "_s0", rest.substr(F.lit(1), size - 1) == tail, size - 1),
        way(some & (F.col("_c1") == F.col("first")), "_s2", some & (rest.substr(F.lit(2), size) == F.col("label")), size + 1),
    ]
    edited = met.where(ways[0][0] | ways[1][0] | ways[2][0])
    left = F.array_compact(F.array(*[F.when(ok, what) for ok, what in ways]))
    return edited.select("word", F.col("child").alias("node"), F.explode(left).alias("rest"))


def neighbours(words: DataFrame) -> DataFrame:
    """Pairs of words exactly one edit apart, both ways: word, near, n (of near).

    The frontier holds (word, node, rest): the word has met its one edit and stands at the node
    with ``rest`` still to be spelt. Level by level it is joined with the edges that begin with
    the next character. States that end where a word ends are neighbours. Every level is a table,
    so that nothing is collected and a lost executor costs one level at most.
    """
    sides = keep_table(spellings(words), "spellings")
    places, edges = trie(sides)
    places, edges = keep_table(places, "places"), keep_table(edges, "edges")
    frontier = keep_table(_after_one_edit(places, edges), "frontier")
    # The last character left out, where that is a word.
    found = [places.where((F.length("rest") == 1) & F.col("ends")).select("word", "node")]
    while True:
        found.append(frontier.where("rest = ''").select("word", "node"))
        moving = frontier.where("rest != ''").withColumn("first", F.ascii("rest"))
        if moving.isEmpty():
            break
        left = F.col("rest").substr(F.length("label") + 1, F.length("rest"))
        ahead = moving.join(edges, ["node", "first"]).where(F.startswith("rest", "label")).where(_open(_slot(left)))
        frontier = keep_table(ahead.select("word", F.col("child").alias("node"), left.alias("rest")), "frontier")
    ended = found[0]
    for level in found[1:]:
        ended = ended.union(level)
    pairs = ended.join(sides.select(F.col("id").alias("node"), F.col("word").alias("near"), "n"), "node")
    # Only ids of words are met here, and nodes are digests: the distance itself decides.
    return pairs.where(F.levenshtein("word", "near") == 1).select("word", "near", "n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and root of all words with a form: forms are followed to the last.

    A form occurs at least ten times as often as its word, so chains are short; each round
    doubles the steps that are taken.
    """
    now = keep_table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = keep_table(now.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        now = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return now


def spelling_variants(
    documents: DataFrame, shortest: int = 7, least: int = 2, times: int = 10, share: int = 31
) -> DataFrame:
    """Words of all texts with their frequent neighbours: word, form, root, n, n_near, form_n.

    Words are runs of Latin letters, A-Z lower-cased, of at least ``shortest`` code points that
    occur at least ``least`` times; of one in ``share`` runs of a document a letter is left out
    first, as a misspelling. ``form`` is the most frequent word one edit away, if it occurs
    ``times`` as often; ties go to the first in code-point order. ``root`` follows the forms.

    Null and empty texts have no words; a null doc_id counts as an empty id; repeated rows count
    as often as they come. Words of any length are compared whole. An empty table gives an empty
    result. Columns other than doc_id and text are not read.
    """
    words = keep_table(word_counts(documents, share, shortest).where(F.col("n") >= least), "words")
    near = neighbours(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus"), F.col("near").alias("near"))).alias("best")
    )
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.minus") >= times * F.col("n"), F.col("best.near")).alias("form"),
        F.when(-F.col("best.minus") >= times * F.col("n"), -F.col("best.minus")).alias("form_n"),
    )
    judged = keep_table(judged, "judged")
    last = roots(judged.where("form IS NOT NULL"))
    return judged.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
