"""Words as numbers: each distinct word is hashed once a worker, texts become arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

#: Words a worker remembers before it starts anew; bounds its memory (some 40 MB for usual words).
REMEMBERED = 250_000


class Ids(dict):
    """Numbers for words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class WordHashes:
    """Lower-cases A to Z and splits at space and U+0009 to U+000D, which is what bytes.lower and bytes.split do.

    `tagger`, if given, says a number for each hash; like the hash itself it is found once a word.
    """

    def __init__(self, tagger: Callable[[np.ndarray], np.ndarray] | None = None):
        self.ids = Ids()
        self.tagger = tagger
        self.hashes = np.zeros(0, np.uint64)
        self.tags = np.zeros(0, np.int64)

    def _places(self, text: str) -> np.ndarray:
        """Each word's place in the tables, which hold until the next text."""
        ids = self.ids
        if len(ids) > REMEMBERED:
            ids.clear()
        words = text.encode("utf-8", "surrogatepass").lower().split()
        known = len(ids)
        at = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        if len(ids) > known:
            if len(ids) > len(self.hashes):
                for name in ("hashes", "tags"):
                    old = getattr(self, name)
                    grown = np.zeros(max(1024, 2 * len(ids)), old.dtype)
                    grown[:known] = old[:known]
                    setattr(self, name, grown)
            fresh = ids if known == 0 else [w for w in dict.fromkeys(words) if ids[w] >= known]
            self.hashes[known : len(ids)] = [xxhash.xxh3_64_intdigest(w) for w in fresh]
            if self.tagger:
                self.tags[known : len(ids)] = self.tagger(self.hashes[known : len(ids)])
        return at

    def of(self, text: str) -> np.ndarray:
        """The hash of every word, in order."""
        at = self._places(text)
        return self.hashes[at]

    def tagged(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The hash and the tag of every word, in order."""
        at = self._places(text)
        return self.hashes[at], self.tags[at]


_HASHER: list[WordHashes] = []


def hasher() -> WordHashes:
    """One a worker process."""
    if not _HASHER:
        _HASHER.append(WordHashes())
    return _HASHER[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_of(value) -> str:
    return value if isinstance(value, str) else ""
