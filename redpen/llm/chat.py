"""Chat formatting by token assembly: reserved ids, loss masks, escaped control strings."""

import re

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from redpen.llm.common import slices

# Fixed values of the template. The reserved ids follow the vocabulary.
RESERVED = {"<|im_start|>": 50257, "<|im_end|>": 50258}
START, END = RESERVED.values()
TRAINED_ROLE = "assistant"
NEWLINE = "\n"
# An opening bracket, any number of escapes, a bar: one escape more or less.
UNESCAPED = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")

AT_A_TIME = 100  # rows that are Python objects at a time

_LOADED: dict[str, Tokenizer] = {}


def escape(text: str) -> str:
    """No ``<|`` is left, so a control string in a text never reads as control."""
    return UNESCAPED.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def loaded(path: str) -> Tokenizer:
    if path not in _LOADED:
        _LOADED[path] = Tokenizer.from_file(path)
        _LOADED[path].encode_special_tokens = True
    return _LOADED[path]


def encode_turns(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """Ids of the escaped role and the escaped text of every turn, each encoded on its own."""

    def run(batches):
        encoder = loaded(tokenizer)
        for batch in slices(batches, AT_A_TIME):
            ids = [
                [e.ids for e in encoder.encode_batch_fast([escape(t or "") for t in batch.column(c).to_pylist()],
                                                          add_special_tokens=False)]
                for c in (2, 3)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(x, pa.list_(pa.int32())) for x in ids]],
                names=["conv_id", "turn", "role_ids", "text_ids"],
            )

    columns = [F.col(c).cast(t) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))]
    return conversations.select(*columns).mapInArrow(
        run, "conv_id long, turn long, role_ids array<int>, text_ids array<int>"
    )


def format_conversations(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One token sequence per conversation: conv_id, ids, loss_mask.

    Every turn reads ``<|im_start|>role, newline, text, <|im_end|>, newline``. The two control
    strings are reserved ids spliced between segments that are encoded separately; texts and
    roles are escaped first. The mask is the running sum of +1 where a trained text starts
    and -1 where it ends, so it covers exactly the texts of assistant turns.

    Turns are ordered by turn, then by their ids; a null turn comes first; repeated rows are
    repeated turns. A null text or role is empty. Rows with a null conv_id form one
    conversation. An empty table gives an empty result. Other columns are not read.
    """
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    encoder = loaded(tokenizer)
    trained = encoder.encode(TRAINED_ROLE, add_special_tokens=False).ids
    newline = encoder.encode(NEWLINE, add_special_tokens=False).ids

    def assemble(batches):
        for batch in slices(batches, AT_A_TIME):
            all_ids, all_masks = [], []
            for turns in batch.column(1).to_pylist():
                segments, steps, at = [], [], 0
                for turn in turns:
                    role, text = turn["role_ids"], turn["text_ids"]
                    segments.append([START, *role, *newline, *text, END, *newline])
                    if role == trained:
                        begin = at + 1 + len(role) + len(newline)
                        steps += [(begin, 1), (begin + len(text), -1)]
                    at += len(segments[-1])
                change = np.zeros(at + 1, np.int32)
                if steps:
                    places, signs = np.array(steps).T
                    np.add.at(change, places, signs)
                all_ids.append(np.concatenate([np.array(s, np.int32) for s in segments]))
                all_masks.append(np.cumsum(change)[:-1].astype(np.int8))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_masks, pa.list_(pa.int8()))],
                names=["conv_id", "ids", "loss_mask"],
            )

    turns = F.array_sort(F.collect_list(F.struct("turn", "role_ids", "text_ids")))
    grouped = encode_turns(conversations, tokenizer).groupBy("conv_id").agg(turns.alias("turns"))
    return grouped.mapInArrow(assemble, "conv_id long, ids array<int>, loss_mask array<tinyint>")


def decode(ids, encoder: Tokenizer) -> str:
    """Text of ids, reserved ids as their control strings."""
    names = {v: k for k, v in RESERVED.items()}
    out, plain = [], []
    for i in ids:
        if i in names:
            out += [encoder.decode(plain, skip_special_tokens=False), names[i]]
            plain = []
        else:
            plain.append(i)
    return "".join([*out, encoder.decode(plain, skip_special_tokens=False)])


def read_back(formatted: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """What a formatted conversation holds, from its ids and mask alone.

    conv_id, formatted (text), roles, texts (unescaped, per turn), trained (unescaped text of
    every masked run).
    """
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        encoder = loaded(tokenizer)
        for batch in slices(batches, AT_A_TIME):
            rows = []
            for ids, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = decode(ids, encoder)
                turns = [t.split("<|im_end|>")[0].split(NEWLINE, 1) for t in text.split("<|im_start|>")[1:]]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
                runs = [unescape(decode(ids[a:b], encoder)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
                rows.append((text, [unescape(r) for r, _ in turns], [unescape(t) for _, t in turns], runs))
            texts, roles, bodies, trained = zip(*rows, strict=True) if rows else ((), (), (), ())
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), *[pa.array(x, strings) for x in (roles, bodies, trained)]],
                names=["conv_id", "formatted", "roles", "texts", "trained"],
            )

    return formatted.select("conv_id", "ids", "loss_mask").mapInArrow(
        run, "conv_id long, formatted string, roles array<string>, texts array<string>, trained array<string>"
    )
