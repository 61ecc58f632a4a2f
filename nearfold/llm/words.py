"""Words and their hashes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The maximal runs of letters and digits after NFKC normalisation and lower-casing; none for null."""
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower()) if text else []


def word_blocks(text: str, size: int, overlap: int) -> Iterator[list[str]]:
    """The words of a text in blocks of about ``size``, each beginning with the last ``overlap`` words of the one before."""
    found = (m.group() for m in _WORD.finditer(unicodedata.normalize("NFKC", text).lower()))
    block = list(islice(found, size))
    while block:
        yield block
        more = list(islice(found, size))
        block = block[len(block) - overlap :] + more if more else []


class Hasher:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, remembered: int = 1_000_000) -> None:
        self.known: dict[str, int] = {}
        self.remembered = remembered

    def __call__(self, found: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        out = np.empty(len(found), np.uint64)
        for i, w in enumerate(found):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out[i] = h
        return out
