"""Words as several operators take them: A-Z in lower case, then runs of digits, a-z and anything beyond ASCII.

In UTF-8 every byte beyond ASCII is at least 0x80, so a byte table does the work of the character class
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np

#: A-Z to a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The same, and every byte that ends a word to a space.
WORD = bytes(LOWER[c] if LOWER[c] >= 128 or chr(LOWER[c]).isalnum() else 32 for c in range(256))


def words(raw: bytes) -> list[bytes]:
    return raw.translate(WORD).split()


def word_offsets(raw: bytes) -> list[tuple[int, int]]:
    """Where each word starts and ends, in bytes."""
    out, at = [], 0
    low = raw.translate(WORD)
    for w in low.split():
        at = low.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


def flat_ids(texts: list[bytes], get: Callable[[bytes, int], int], step: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words of texts, one after the other (0: unknown), and each text's count of words."""
    ids, counts = [], []
    lists: list[list[bytes]] = []
    size = 0
    for k, text in enumerate(texts):
        lists.append(words(text))
        size += len(text)
        if size >= step or k + 1 == len(texts):
            n = list(map(len, lists))
            ids.append(np.fromiter(map(get, chain.from_iterable(lists), repeat(0)), np.int32, sum(n)))
            counts += n
            lists, size = [], 0
    return np.concatenate(ids) if ids else np.empty(0, np.int32), np.array(counts, np.int64)


class Pairs:
    """A set of pairs of ids with a quick test for many: a table of bits, then a search for what it lets through."""

    BITS = 22

    def __init__(self, pairs: np.ndarray):
        self.keys = np.unique(pairs)
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[self._slot(self.keys)] = True

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(-7046029254386353131)) >> 40) & ((1 << self.BITS) - 1)

    def links(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """True at i if ids i and i + 1 are of one text (ends: where texts end) and a pair of the set."""
        out = np.zeros(len(ids), bool)
        if len(ids) < 2 or not len(self.keys):
            return out
        both = (ids[:-1] > 0) & (ids[1:] > 0)
        inner = ends[(ends > 0) & (ends < len(ids))]
        both[inner - 1] = False
        at = np.flatnonzero(both)
        keys = self.key(ids[at], ids[at + 1])
        some = self.table[self._slot(keys)]
        at, keys = at[some], keys[some]
        found = np.searchsorted(self.keys, keys)
        out[at[self.keys[np.minimum(found, len(self.keys) - 1)] == keys]] = True
        return out


def runs(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length (in words) of the maximal runs of linked words."""
    edge = np.diff(np.concatenate(([0], links.astype(np.int8), [0])))
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start + 1
