"""Token ids of whole texts, with a bounded memory of words already seen."""

import re

import numpy as np
from tokenizers import Tokenizer

# Words of these letters, with at most one mark at the end, are a word and a mark to the
# tokenizer's own splitting rule; its model alone gives their ids.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]?)")
MOST_CHUNKS = 400_000
MOST_WORDS = 800_000


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Words(dict):
    """Ids of a lower-case word as little-endian bytes."""

    def __init__(self, model):
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, word):
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = ids
        return ids


class _Chunks(dict):
    """Ids of a run without blanks as little-endian bytes. White space never reaches a token."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.words = _Words(tokenizer.model)

    def __missing__(self, chunk):
        plain = PLAIN.fullmatch(chunk)
        if plain:
            ids = self.words[plain[1].lower()]
            if plain[2]:
                ids += self.words[plain[2]]
        else:
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= MOST_CHUNKS:
            self.clear()
        self[chunk] = ids
        return ids


_LOADED: dict[str, _Chunks] = {}


def word_bpe(path: str):
    """A function from a text to its ids, four little-endian bytes each.

    For tokenizers that drop white space, lower-case, and split into words: the ids of a
    text are then those of its runs between blanks. Equal to encoding the text as a whole
    without special tokens. One memory per Python worker, bounded in entries.
    """
    if path not in _LOADED:
        _LOADED[path] = _Chunks(Tokenizer.from_file(path))
    chunks = _LOADED[path]

    def encode(text: str) -> bytes:
        return b"".join(map(chunks.__getitem__, text.replace("\n", " ").split(" ")))

    return encode
