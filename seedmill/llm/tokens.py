"""Tokenizing at scale: the tokenizers library behind a bounded memo of words.

The vocabulary file drops white space and never joins across it, so a text's ids are those of its
words, one after the other. Arrow splits the texts at ASCII white space and numbers the distinct words of some megabytes; only
words that the memo lacks go on to the library. The memo holds up to ``MEMO`` words (the first that a worker meets, hence
mostly the frequent ones) and their ids in flat arrays. Of new words, those of Latin-1 letters go to the library in lower
case and as one string; its word-end tokens tell where each word's ids end. All others go to it one by one.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words a worker remembers; about 120 MB.
MEMO = 600_000
#: Longer words are encoded but not remembered.
LONG = 64
#: Bytes of text that are split at once.
STEP = 8 << 20
#: Marks that close a word (apostrophes are left to the library), and words of Latin-1 letters. A special token is neither.
MARKS, LETTERS = string.punctuation.replace("'", ""), r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+$"


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each row, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - size), size) + np.arange(total)]


class Memo:
    """Words and their ids: each word's number, and where its ids lie in one array."""

    def __init__(self, most: int = MEMO):
        self.most = most
        self.number: dict[str, int] = {}
        self.start, self.size, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def find(self, words: list[str]) -> np.ndarray:
        """Each word's number, or -1."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def add(self, words: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        """Takes different words in as far as they are new and there is room."""
        if len(self.number) >= self.most:
            return
        keep = [k for k, w in enumerate(words) if len(w) <= LONG and w not in self.number][: self.most - len(self.number)]
        if not keep:
            return
        start, n = np.cumsum(size) - size, len(self.start)
        self.number.update((words[k], n + i) for i, k in enumerate(keep))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size[keep]) - size[keep]))
        self.size = np.concatenate((self.size, size[keep]))
        self.flat = np.concatenate((self.flat, ragged(flat, start[keep], size[keep])))


class WordEncoder:
    """encode() gives the ids that Tokenizer.encode would."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.memo = Memo()

    def _plain(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different lower-case words of letters, one after the other, and the count of each word's."""
        if not names:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        ids = np.array(self.letters.encode_batch_fast([" ".join(names)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(cuts, prepend=0)) if len(cuts) == len(names) else self._each(names)

    def _each(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(names, add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words that the memo lacks, one after the other, and the count of each word's.

        A word of letters and closing marks has the ids of the word in lower case, then those of the marks.
        """
        bare = pc.utf8_rtrim(words, characters=MARKS)
        plain = np.flatnonzero(pc.match_substring_regex(bare, LETTERS).to_numpy(zero_copy_only=False))
        lows = pc.utf8_lower(bare.take(pa.array(plain))).dictionary_encode()
        names = lows.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = self.memo.find(names)
        fresh = [names[k] for k in np.flatnonzero(number < 0).tolist()]
        ids, size = self._plain(fresh)
        self.memo.add(fresh, ids, size)
        # Most words close without a mark: kind 0.
        length = pc.binary_length(bare).to_numpy()[plain]
        marked = np.flatnonzero(pc.binary_length(words).to_numpy()[plain] > length)
        marks = [w[n:] for w, n in zip(words.cast(pa.binary()).take(pa.array(plain[marked])).to_pylist(), length[marked].tolist(), strict=True)]
        kinds = {m: k for k, m in enumerate(dict.fromkeys([b"", *marks]))}
        mark_ids, mark_size = self._each([m.decode() for m in kinds])
        rest = np.setdiff1d(np.arange(len(words)), plain)
        rest_ids, rest_size = self._each(words.take(pa.array(rest)).to_pylist())
        # Each word is two stretches of one array: of letters and of marks, or of all its ids and of nothing.
        flat = np.concatenate((self.memo.flat, ids, mark_ids, rest_ids))
        at = np.cumsum([0, len(self.memo.flat), len(ids), len(mark_ids)])
        low_start, low_size = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
        old = number >= 0
        low_start[old], low_size[old] = self.memo.start[number[old]], self.memo.size[number[old]]
        low_start[~old], low_size[~old] = at[1] + np.cumsum(size) - size, size
        start, count = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        of = lows.indices.to_numpy()
        start[plain, 0], count[plain, 0] = low_start[of], low_size[of]
        kind = np.zeros(len(plain), np.int64)
        kind[marked] = [kinds[m] for m in marks]
        start[plain, 1], count[plain, 1] = (at[2] + np.cumsum(mark_size) - mark_size)[kind], mark_size[kind]
        start[rest, 0], count[rest, 0] = at[3] + np.cumsum(rest_size) - rest_size, rest_size
        return ragged(flat, start.ravel(), count.ravel()), count.sum(1)

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts and each text's count."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        at, flat = self.memo.find(words), self.memo.flat
        known, lacks = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        start, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        start[known], size[known] = self.memo.start[at[known]], self.memo.size[at[known]]
        if len(lacks):
            new = [words[k] for k in lacks.tolist()]
            ids, count = self._learn(coded.dictionary.take(pa.array(lacks)))
            start[lacks], size[lacks] = len(flat) + np.cumsum(count) - count, count
            flat = np.concatenate((flat, ids))
            self.memo.add(new, ids, count)
        counts = size[index]
        ends = np.concatenate(([0], np.cumsum(counts)))
        cuts = split.offsets.to_numpy()
        return ragged(flat, start[index], counts), np.diff(ends[cuts - cuts[0]])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none), one after the other, and each text's count."""
        ids, counts = [], []
        for part in _steps(texts):
            found, count = self._words(part)
            ids.append(found)
            counts.append(count)
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.empty(0, np.uint32), np.empty(0, np.int64))


def _steps(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of at most STEP bytes."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - size[a] + STEP, "right")))
        yield pc.fill_null(texts.slice(a, b - a), "")
        a = b


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    return WordEncoder(path)


def with_ends(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text."""
    counts = counts + 1
    out = np.full(int(counts.sum()), end_id, np.uint32)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(counts) - 1] = False
    out[inner] = ids
    return out, counts


def crc(ids: bytes) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids) & 0xFFFFFFFF
