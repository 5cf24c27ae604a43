"""Operator 4: benchmark decontamination by an FM-index for each shard of documents.

A shard (a task's documents, in pieces of some ``SHARD_BYTES``) becomes one sequence of word ids. Its FM-index (suffix array, Burrows-Wheeler
transform, wavelet matrix, sampled suffix positions) answers all windows of the benchmark at once by backward
search; occurrences are located by walking to sampled positions, and overlapping ones merge into removal spans.

Only stretches in which every pair of neighbours is a pair of some benchmark window enter the index. No
occurrence of a window can lie outside of them, so nothing is lost and the indexes stay small.

Scale: one scan of the documents and no shuffle. The benchmark is the stated query set; it is measured first and
taken in blocks of at most ``BLOCK_BYTES`` (arrays of some 20 times that on the driver and in each worker), each
broadcast by itself and searched in turn within the same scan.

Defined results: null or empty texts have no words and no hits; repeated rows are judged one by one; an item without
words (or null) has no window; items under one id count once, a null item_id is not listed; empty tables are fine; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, id_text, map_shards, text_bytes
from .words import Pairs, flat_ids, runs, word_offsets, words

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Documents of a task that share an index. The whole benchmark is searched once for each shard, so small ones cost more.
SHARD_BYTES = 32 << 20
SAMPLE = 8
SPAN = pa.struct([("first", pa.int64()), ("words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of text in order, by prefix doubling; every 0 is a separator of its own and below all others."""
    n, sep = len(text), text == 0
    rank = np.where(sep, np.cumsum(sep) - 1, text.astype(np.int64) + int(sep.sum()))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
        if new[-1] == n - 1 or step >= n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2


class FMIndex:
    """Backward search and location over a text of ids in 1..sigma; 0 separates stretches and ends the text."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        self.n = len(text)
        order = suffix_array(text)
        self.bwt = text[order - 1].astype(np.int64)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma + 1))))[: sigma + 1]
        self.levels = []
        seq = self.bwt
        for bit in reversed(range(max(1, int(sigma).bit_length()))):
            ones = (seq >> bit) & 1
            self.levels.append((bit, np.concatenate(([0], np.cumsum(ones))), self.n - int(ones.sum())))
            seq = np.concatenate((seq[ones == 0], seq[ones == 1]))
        self.begin = self._down(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))
        # The start of each stretch is a sample too, so that a walk never crosses a separator.
        starts = np.concatenate(([True], text[:-1] == 0))
        self.sampled = (order % sample == 0) | starts[order]
        self.samples = order[self.sampled]
        self.sample_no = np.cumsum(self.sampled) - 1

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, ones, zeros in self.levels:
            before = ones[at]
            at = np.where((symbol >> bit) & 1 == 1, zeros + before, at - before)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol stands in the first at places of the transform."""
        return self._down(symbol, at) - self.begin[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of patterns (one each) that occur, with their ranges of suffixes."""
        alive = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in reversed(range(patterns.shape[1])):
            symbol = patterns[alive, k]
            low, high = self.less[symbol] + self.rank(symbol, low), self.less[symbol] + self.rank(symbol, high)
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array."""
        out, live, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(rows):
            here = self.sampled[rows]
            out[live[here]] = self.samples[self.sample_no[rows[here]]] + steps
            live, rows = live[~here], rows[~here]
            symbol = self.bwt[rows]
            rows = self.less[symbol] + self.rank(symbol, rows)
            steps += 1
        return out


class Windows:
    """The windows of a block of benchmark items, as arrays: patterns by their length, and the items of each."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        ids = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words((text or "").encode())], np.int32) for _, text in items]
        self.names = sorted({str(item) for item, _ in items if item is not None})
        number = {name: k for k, name in enumerate(self.names)}
        owner = np.array([-1 if item is None else number[str(item)] for item, _ in items], np.int64)
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([np.empty(0, np.int32), *ids])
        of = np.repeat(np.arange(len(size)), size)
        inner = of[1:] == of[:-1]
        self.pairs = Pairs(Pairs.key(flat[:-1][inner], flat[1:][inner]))
        left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))  # words from here to the item's end
        self.patterns: dict[int, np.ndarray] = {}
        #: Of each length, where each pattern's items begin, and the items as numbers of names.
        self.items: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({*np.minimum(size, window).tolist()} - {0}):
            first = np.concatenate(([True], ~inner)) if len(flat) else np.empty(0, bool)
            start = np.flatnonzero(left >= n) if n == window else np.flatnonzero(first & (left == n))
            rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, n)[start])
            coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * n), len(rows), [None, pa.py_buffer(rows)]).dictionary_encode()
            found = np.frombuffer(coded.dictionary.buffers()[1], np.int32)[: n * len(coded.dictionary)].reshape(-1, n).astype(np.int64)
            holder, known = owner[of[start]], len(self.names) + 1
            pair = np.unique(coded.indices.to_numpy().astype(np.int64) * known + holder + 1)
            pair = pair[pair % known > 0]
            self.patterns[n] = found
            self.items[n] = np.searchsorted(pair // known, np.arange(len(found) + 1)), pair % known - 1
        self.least = min(self.patterns, default=0)
        self.single = np.zeros(len(self.vocab) + 1, bool)
        if 1 in self.patterns:
            self.single[self.patterns[1][:, 0]] = True

    def holders(self, n: int, k: int) -> list[str]:
        """The items that hold pattern k of length n."""
        begin, item = self.items[n]
        return [self.names[x] for x in item[begin[k] : begin[k + 1]].tolist()]

    def hits(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Start, length and items of every occurrence in a shard's words."""
        none = np.empty(0, np.int64), np.empty(0, np.int64), []
        if not self.least or not len(ids):
            return none
        links = self.pairs.links(ids, ends)
        start, size = runs(links)
        if self.least == 1:
            alone = np.flatnonzero(self.single[ids] & ~links & ~np.concatenate(([False], links[:-1])))
            start, size = np.concatenate((start, alone)), np.concatenate((size, np.ones(len(alone), np.int64)))
        start, size = start[size >= self.least], size[size >= self.least]
        if not len(start):
            return none
        begin = np.cumsum(size + 1) - size - 1
        text = np.zeros(int((size + 1).sum()), np.int64)
        place = np.repeat(start - begin, size) + (at := np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size))
        text[at] = ids[place]
        origin = np.zeros(len(text), np.int64)
        origin[at] = place
        index = FMIndex(text, len(self.vocab))
        found = []
        for n, patterns in self.patterns.items():
            which, low, high = index.search(patterns)
            count = high - low
            rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            where = origin[index.locate(rows)]
            found.append((where, np.full(len(where), n), [self.holders(n, k) for k in np.repeat(which, count).tolist()]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), [x for f in found for x in f[2]]


FOUND = {"n_words": "bigint", "items": "array<string>", "spans": "array<struct<first:bigint,words:bigint,start:bigint,end:bigint>>"}


def search(rows: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, prefix: str = "", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """rows with n_words, items (sorted ids of items found) and spans to remove (words and bytes), named with prefix."""
    spark = rows.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-int(total) // block_bytes))
    empty = {"n_words": F.lit(0), "items": F.array(), "spans": F.array()}
    out = rows.withColumns({prefix + k: empty[k].cast(t) for k, t in FOUND.items()})
    schema = out.schema
    held = []
    for k in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("text", "item"), F.lit(blocks)) == k)
        held.append(spark.sparkContext.broadcast(Windows([tuple(r) for r in block.collect()], window)))
    return out.mapInArrow(map_shards(_searcher(held, text_col, prefix), shard_bytes), schema)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document: doc_id, text, n_words, items and spans."""
    return search(id_text(docs, id_col, text_col), benchmark, window, "text", item_col, item_text_col, block_bytes, shard_bytes=shard_bytes)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, in which no window occurs."""
    prefix = "_found_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    found = search(docs, benchmark, window, text_col, prefix=prefix)
    return found.filter(F.size(f"{prefix}spans") == 0).drop(*(prefix + k for k in FOUND))


def _in_turn(held: list) -> Iterator[Windows]:
    """The blocks, one in memory at a time; a single one stays for the worker's next shards."""
    for block in held:
        yield block.value
        # Without its value a broadcast is read again from its file; one that came without a file keeps it.
        if len(held) > 1 and getattr(block, "_path", None):
            block.__dict__.pop("_value", None)


def _searcher(held: list, text_col: str, prefix: str):
    """Searches a shard for all blocks, one after the other in the same worker."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_bytes(batch, text_col)
        items, spans = column(batch, f"{prefix}items").to_pylist(), column(batch, f"{prefix}spans").to_pylist()
        for windows in _in_turn(held):
            ids, counts = flat_ids(texts, windows.vocab.get)
            ends = np.cumsum(counts)
            where, size, names = windows.hits(ids, ends)
            if len(where):
                of = np.searchsorted(ends, where, "right")
                order = np.argsort(of, kind="stable")
                for mine in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                    _merge(int(of[mine[0]]), mine, where, size, names, ends, counts, texts, items, spans)
        arrays = {f"{prefix}n_words": pa.array(counts), f"{prefix}items": pa.array(items, pa.list_(pa.string())), f"{prefix}spans": pa.array(spans, pa.list_(SPAN))}
        return pa.RecordBatch.from_arrays([arrays.get(f.name, column(batch, f.name)) for f in batch.schema], [f.name for f in batch.schema])

    return run


def _merge(k: int, mine: np.ndarray, where, size, names, ends, counts, texts, items: list, spans: list) -> None:
    """Add document k's occurrences to its items and spans."""
    items[k] = sorted({*items[k], *(x for m in mine.tolist() for x in names[m])})
    first = int(ends[k] - counts[k])
    found = sorted([(s["first"], s["first"] + s["words"]) for s in spans[k]] + [(int(where[m]) - first, int(where[m] + size[m]) - first) for m in mine.tolist()])
    merged: list[list[int]] = []
    for a, b in found:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    at = word_offsets(texts[k])
    spans[k] = [{"first": a, "words": b - a, "start": at[a][0], "end": at[b - 1][1]} for a, b in merged]
