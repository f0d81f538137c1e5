"""Ids of the word-level BPE file, by way of a cache of white-space-free pieces.

That tokenizer drops white space before it splits, so no token and no normalisation reaches
across a blank or a line feed: a text's ids are the ids of its pieces, one after another.
Each worker keeps the ids of the pieces that it has met, up to a bound, and has the library
encode the others only. A piece of Latin letters, with one full stop or comma after them at
most, is normalised here (lower case, bytes as the model spells them) and goes straight to the
library's BPE model; every other piece goes through the whole tokenizer.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from tokenizers import Tokenizer

MAX_CACHED = 300_000
#: Letters that composition leaves as they are, in Latin-1 and Latin Extended-A and -B, but for the dotted I, which two characters lower.
_WORD = re.compile("([a-zß-öø-įı-ɏ]+)([.,]?)")
_BEYOND = re.compile("[^\x00-įı-ɏ]")


def spelling() -> dict[int, str]:
    """How byte-level models spell bytes: printable Latin-1 as it is, every other byte, in order, from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}


_SPELLING = spelling()
_WORKER: dict = {}


class _Pieces(dict):
    """Ids of pieces, as bytes of 32-bit integers; a missing one is encoded."""

    def __init__(self, model: str, most: int):
        super().__init__()
        self.most = most
        self.tokenizer, self.words = Tokenizer.from_str(model), {}
        self.tokenize = self.tokenizer.model.tokenize

    def word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            low = word.lower()
            spelt = low if low.isascii() else low.encode().decode("latin-1").translate(_SPELLING)
            ids = self.words[word] = array("I", [t.id for t in self.tokenize(spelt)]).tobytes()
        return ids

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
            self.words.clear()
        found = _WORD.fullmatch(piece)
        if found is None:
            ids = array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        else:
            word, stop = found.groups()
            ids = self.word(word) + self.word(stop) if stop else self.word(word)
        self[piece] = ids
        return ids


def encode_texts(model: str, texts: list[str | None], most: int = MAX_CACHED) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids (uint32), one after another, and how many each text has. ``model``: the tokenizer file's JSON; ``most``: pieces that are kept."""
    if _WORKER.get("model") != (model, most):
        _WORKER.update(model=(model, most), pieces=_Pieces(model, most))
    ids = _WORKER["pieces"].__getitem__
    encoded = []
    for text in texts:
        text = text or ""
        if "<|" not in text and not _BEYOND.search(text):  # else lowering first might change a special token or a composition
            text = text.lower()
        encoded.append(b"".join(map(ids, text.replace("\n", " ").split(" "))))
    return np.frombuffer(b"".join(encoded), np.uint32), np.array([len(e) // 4 for e in encoded], np.int64)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an id after each text."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end)), counts + 1


def read_model(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
