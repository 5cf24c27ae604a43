"""Operator 11: ranked lexical search with dual-sorted wavelet trees.

A shard is up to ``SHARD_BYTES`` of one task's texts. Its documents are numbered by ascending doc_id; the postings of
each term are ordered by impact, largest first, and all lists stand in one sequence of document numbers. A wavelet tree
(kept level by level, zeros before ones) over that sequence halves the documents at each level and leaves the order by impact
inside every node, so the first posting of a term in a node bounds that term for all the node's documents.

A search keeps a frontier of nodes, opens those with the largest sum of such bounds first, scores leaves exactly, and
drops nodes whose bound is under the k-th best score so far; what is left when nothing can be opened is the exact top k.

Scale: one scan counts documents and terms, one builds the index, which is written with a row for each shard; a search reads the
index alone. A task passes on k rows for each item, however many shards it reads; Spark trims them again before the
shuffle. Items are held by executors in blocks of about ``ITEM_BYTES`` (dealt by a hash of their id); each block is a
job of its own over the index, so neither the driver nor an executor holds more than one.

Defined results: null texts and texts without a term are no documents (N does not count them) and items without a term get no
rows; rows of one doc_id are documents of their own, rows without doc_id too (they come last among equal scores); rows of one
item_id are one item with the terms of all; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, column, id_text, map_rows, map_shards, text_bytes
from .words import words

SHARD_BYTES, ITEM_BYTES = 16 << 20, 8 << 20
#: Nodes opened at a time, and how many units of impact a stored bound is rounded up to.
OPEN, UNIT = 64, 16
TOP = 10
INDEX = "ids binary, known binary, sizes binary, terms binary, starts binary, tfs binary, levels array<binary>"


def impacts(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence count adds for each unit of a term's weight, in documents of size terms."""
    m = 10 + (90 * size * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def totals(docs: DataFrame) -> tuple[int, int]:
    """N and L: documents with a term, and all their terms."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = np.fromiter((len(words(t)) for t in text_bytes(batch)), np.int64, batch.num_rows)
        return pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["docs", "terms"])

    row = docs.mapInArrow(map_rows(run), "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return row.docs or 0, row.terms or 0


def _shard(batch: pa.RecordBatch, n_docs: int, n_terms: int) -> pa.RecordBatch | None:
    ids = column(batch, "doc_id")
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy()
    order = np.lexsort((ids, ~known))
    texts = text_bytes(batch)
    lists = [words(texts[k]) for k in order.tolist()]
    del texts
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    some = sizes > 0
    order, sizes = order[some], sizes[some]
    if not len(order):
        return None
    vocabulary: defaultdict[bytes, int] = defaultdict(count().__next__)
    term = np.fromiter(map(vocabulary.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
    del lists
    places, tf = np.unique(term * len(sizes) + np.repeat(np.arange(len(sizes)), sizes), return_counts=True)
    term, doc = places // len(sizes), places % len(sizes)
    # Impacts are under a million; equal ones stay in order of documents.
    by_impact = np.argsort((term << 20) | ((1 << 20) - 1 - impacts(tf, sizes[doc], n_docs, n_terms)), kind="stable")
    doc, tf = doc[by_impact].astype(np.int32), tf[by_impact].astype("<i4")
    starts = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(vocabulary))))).astype("<i4")
    levels = []
    for bit in range(max(1, (len(sizes) - 1).bit_length()) - 1, -1, -1):
        ones = (doc >> bit) & 1 == 1
        levels.append(np.packbits(ones).tobytes())
        doc = np.concatenate((doc[~ones], doc[ones]))
    values = [ids[order].astype("<i8").tobytes(), np.packbits(known[order]).tobytes(), sizes.astype("<i4").tobytes(), b" ".join(vocabulary), starts.tobytes(), tf.tobytes()]
    return pa.RecordBatch.from_arrays([*(pa.array([v], pa.binary()) for v in values), pa.array([levels], pa.list_(pa.binary()))], [c.split()[0] for c in INDEX.split(", ")])


def _sliced(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in slices of about size bytes of text: long texts make large batches."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column(batch, "text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        # A copy: a slice would count the whole batch's bytes as its own.
        yield pa.concat_batches([batch.slice(at, to - at)]) if to - at == batch.num_rows else batch.take(pa.array(range(at, to)))
        at = to


class Index:
    """The written shards of an index, with the counts that its impacts rest on."""

    def __init__(self, shards: DataFrame, n_docs: int, n_terms: int, scratch: Scratch):
        self.shards, self.n_docs, self.n_terms, self.scratch = shards, n_docs, n_terms, scratch


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """Index every document with a term."""
    scratch = Scratch(docs.sparkSession, "lexical")
    rows = id_text(docs, id_col, text_col).filter(F.col("text").isNotNull())
    n_docs, n_terms = totals(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (part for batch in batches for part in _sliced(batch, shard_bytes))
        yield from (x for x in map_shards(lambda b: _shard(b, n_docs, n_terms), shard_bytes)(small) if x is not None)

    return Index(scratch.table(rows.mapInArrow(run, INDEX), "index"), n_docs, n_terms, scratch)


class _Tree:
    """A shard ready to search: counts of ones before each place of a level, and impact bounds in the order of each level."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.ids = np.frombuffer(row["ids"], "<i8")
        n = len(self.ids)
        self.known = np.unpackbits(np.frombuffer(row["known"], np.uint8), count=n).astype(bool)
        sizes = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
        self.m = 8 * (10 + (90 * sizes * n_docs) // n_terms)
        self.starts = np.frombuffer(row["starts"], "<i4")
        tf = np.frombuffer(row["tfs"], "<i4")
        self.depth = len(row["levels"])
        bits = [np.unpackbits(np.frombuffer(packed, np.uint8), count=len(tf)).view(bool) for packed in row["levels"]]
        self.ones = np.zeros((self.depth, len(tf) + 1), np.int32)
        # Where a posting stood at the root, and its document as far as the levels tell, in the order of each level.
        place, doc = np.arange(len(tf), dtype=np.int32), np.zeros(len(tf), np.int32)
        for k, bit in enumerate(bits):
            np.cumsum(bit, dtype=np.int32, out=self.ones[k, 1:])
            place, doc = np.concatenate((place[~bit], place[bit])), np.concatenate((2 * doc[~bit], 2 * doc[bit] + 1))
        self.zeros = len(tf) - self.ones[:, -1]
        self.tf = tf[place]
        bound = np.empty(len(tf), np.uint16)
        bound[place] = -(-impacts(self.tf.astype(np.int64), sizes[doc], n_docs, n_terms) // UNIT)
        self.bounds = np.zeros((self.depth + 1, len(tf) + 1), np.uint16)
        self.bounds[0, :-1] = bound
        for k, bit in enumerate(bits):
            bound = np.concatenate((bound[~bit], bound[bit]))
            self.bounds[k + 1, :-1] = bound

    def best(self, terms: np.ndarray, weights: np.ndarray, top: list[tuple], k: int) -> list[tuple]:
        """The k best (-score, unknown id, id) of top and this shard's documents; terms are numbers of this shard."""
        level = np.zeros(1, np.int64)
        node = np.zeros(1, np.int64)
        left, right = self.starts[terms][None, :], self.starts[terms + 1][None, :]
        bound = self._sum(level, left, right, weights)
        while len(node):
            least = -top[k - 1][0] if len(top) >= k else 1
            alive = np.flatnonzero(bound >= least)
            if len(alive) < len(bound):
                level, node, left, right, bound = level[alive], node[alive], left[alive], right[alive], bound[alive]
                if not len(node):
                    break
            some = np.argpartition(-bound, OPEN)[:OPEN] if len(bound) > OPEN else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[some] = False
            at, lo, hi = level[some], left[some], right[some]
            lo1, hi1 = self.ones[at[:, None], lo], self.ones[at[:, None], hi]
            zero = self.zeros[at][:, None].astype(np.int32)
            new_level = np.concatenate((at, at)) + 1
            new_node = np.concatenate((2 * node[some], 2 * node[some] + 1))
            new_left, new_right = np.concatenate((lo - lo1, zero + lo1)), np.concatenate((hi - hi1, zero + hi1))
            leaf = new_level == self.depth
            if leaf.any():
                top = self._scored(new_node[leaf], new_left[leaf], new_right[leaf], weights, top, k)
            inner = ~leaf
            new_bound = self._sum(new_level[inner], new_left[inner], new_right[inner], weights)
            level, node, bound = np.concatenate((level[rest], new_level[inner])), np.concatenate((node[rest], new_node[inner])), np.concatenate((bound[rest], new_bound))
            left, right = np.concatenate((left[rest], new_left[inner])), np.concatenate((right[rest], new_right[inner]))
        return top

    def _sum(self, level: np.ndarray, left: np.ndarray, right: np.ndarray, weights: np.ndarray) -> np.ndarray:
        first = self.bounds[level[:, None], left]
        return UNIT * (np.where(right > left, first, 0).astype(np.int64) @ weights)

    def _scored(self, doc: np.ndarray, left: np.ndarray, right: np.ndarray, weights: np.ndarray, top: list[tuple], k: int) -> list[tuple]:
        has = right > left
        some = np.flatnonzero(has.any(axis=1))
        doc, left, has = doc[some], left[some], has[some]
        if not len(doc):
            return top
        tf = self.tf[np.where(has, left, 0)].astype(np.int64)
        score = np.where(has, (1_000_000_000 * tf) // (1000 * tf + self.m[doc][:, None]), 0) @ weights
        found = [(-s, not known, i) for s, known, i in zip(score.tolist(), self.known[doc].tolist(), self.ids[doc].tolist(), strict=True) if s > 0]
        return sorted(top + found)[:k]


def _local(terms: bytes, wanted: dict[bytes, int]) -> dict[bytes, int]:
    """Numbers of wanted terms in a shard."""
    return {t: k for k, t in enumerate(terms.split()) if t in wanted}


def _frequencies(index: Index, wanted) -> dict[bytes, int]:
    """In how many documents each wanted term occurs; one row for each goes to the driver."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: defaultdict[bytes, int] = defaultdict(int)
        for terms, starts in zip(column(batch, "terms").to_pylist(), column(batch, "starts").to_pylist(), strict=True):
            n = np.diff(np.frombuffer(starts, "<i4"))
            for t, k in _local(terms, wanted.value).items():
                found[t] += int(n[k])
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["term", "df"])

    rows = index.shards.select("terms", "starts").mapInArrow(map_rows(run), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {bytes(r.term): r.df for r in rows}


def _search_block(index: Index, items: dict[int | None, list[bytes]], k: int) -> DataFrame:
    """The k best documents of each item in each task's shards: item_id, doc_id, score."""
    spark = index.shards.sparkSession
    n_docs, n_terms = index.n_docs, index.n_terms
    wanted = spark.sparkContext.broadcast(dict.fromkeys(chain.from_iterable(items.values()), 0))
    weights = {t: weight(n_docs, df) for t, df in _frequencies(index, wanted).items()}
    wanted.unpersist()
    queries = [(item, [(t, weights[t]) for t in terms if weights.get(t)]) for item, terms in items.items()]
    held = spark.sparkContext.broadcast((weights, [q for q in queries if q[1]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = held.value
        tops: list[list[tuple]] = [[] for _ in queries]
        for batch in batches:
            for row in range(batch.num_rows):
                shard = batch.slice(row, 1).to_pylist()[0]
                local = _local(shard["terms"], weights)
                if not local:
                    continue
                tree = _Tree(shard, n_docs, n_terms)
                for q, (_, terms) in enumerate(queries):
                    own = [(local[t], w) for t, w in terms if t in local]
                    if own:
                        number, w = np.array(own, np.int64).T
                        tops[q] = tree.best(number, w, tops[q], k)
        found = [(queries[q][0], None if unknown else doc, -score) for q, top in enumerate(tops) for score, unknown, doc in top]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["item_id", "doc_id", "score"])

    return index.shards.mapInArrow(run, "item_id long, doc_id long, score long")


def search(index: Index, items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Per item its k best documents with a score above 0: item_id, rank (from 1), doc_id, score."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // item_bytes
    parts = []
    for block in range(n if index.n_docs else 0):
        own: defaultdict[int | None, dict[bytes, None]] = defaultdict(dict)
        for r in rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block).toLocalIterator():
            own[r.item_id] |= dict.fromkeys(words(r.text.encode()))
        if own:
            parts.append(index.scratch.table(_search_block(index, {i: list(t) for i, t in own.items()}, k), f"top{block}"))
    schema = "item_id long, doc_id long, score long"
    found = index.shards.sparkSession.createDataFrame([], schema)
    for part in parts:
        found = found.unionByName(part)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
