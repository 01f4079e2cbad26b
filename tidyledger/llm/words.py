"""Words of a UTF-8 text as bytes, and their 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

# What counts as part of a word. A-Z become a-z; digits, a-z and all beyond ASCII stay; the rest parts.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
KNOWN = 60_000  # words of a generation of a memo
LONGEST = 64  # letters of a word that a memo keeps


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Memo(dict):
    """Values of words, worked out once.

    Two generations bound its memory, the older one goes when one is full; words of any length are not kept.
    """

    def __init__(self, value, known: int = KNOWN):
        super().__init__()
        self._value = value
        self._known = known
        self._old: dict = {}

    def __missing__(self, word):
        if len(word) > LONGEST:
            return self._value(word)
        if len(self) >= self._known:
            self._old = dict(self)
            self.clear()
        value = self._old.get(word)
        if value is None:
            value = self._value(word)
        self[word] = value
        return value


def word_hashes(memo: Memo, found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))


def hash_memo() -> Memo:
    return Memo(xxhash.xxh64_intdigest)


def mixed(value: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit numbers over all bits."""
    value = (value ^ (value >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return value ^ (value >> np.uint64(29))


def grams(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` words; runs hashed with different seeds never meet."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    value = np.full(len(hashes) - size + 1, seed, np.uint64)
    for i in range(size):
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(value)])
    return value
