"""Operator 7: exact dedup over an extendible-hash index on shared files.

1. ``keys``: every row's 64-bit hash and SHA-256 of its normalised text, written narrow.
2. ``directory``: a histogram over hash prefixes; the directory doubles and overfull buckets split on one more bit
   until every bucket holds at most its capacity of text (or the depth is used up).
3. Scan tasks send each distinct text once with its bucket, and later only counts; so a group of copies that fills a
   third of the table is a few rows for each task. Owner tasks hold ranges of keys in order, chain texts that
   share a hash, and tell them apart by comparing bytes. Their rows are the index, on shared files.
4. Every row looks up its group: the directory gives its key's bucket, and the key is found in that bucket's part of the index.

Scale: texts are shuffled once and only one per task and group; look-ups are a join of narrow rows that Spark splits
where a key is hot. The directory has at most 2^20 entries of 4 bytes and is the only thing that is broadcast; the histogram
that it is made of comes to the driver as at most 2^20 rows of 16 bytes, however large the input is.

Defined results: null counts as empty text; of a group the least non-null doc_id stays (null if all are null); rows that
repeat the kept doc_id in its group are that document again and are kept too; empty tables give no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, id_text, map_rows, shuffle_partitions, text_bytes

#: Bytes of text that a bucket holds, and bits that the directory has at most.
CAPACITY, DEPTH = 64 << 20, 20
#: Bytes of texts that a scan task remembers so as not to send them again.
REMEMBER = 48 << 20
SPACE = b" \t\n\r\x0b\x0c"


def normalise(raw: bytes) -> bytes:
    """Every run of white space (U+0020, U+0009 to U+000D) as one space."""
    parts = raw.split()
    if not parts:
        return b" " if raw else b""
    return (b" " if raw[0] in SPACE else b"") + b" ".join(parts) + (b" " if raw[-1] in SPACE else b"")


def key_of(text: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(text), "big", signed=True)


def keys(docs: DataFrame) -> DataFrame:
    """doc_id, h, sha and n_bytes of every row's normalised text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [normalise(t) for t in text_bytes(batch)]
        return pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), pa.array([key_of(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64())],
            ["doc_id", "h", "sha", "n_bytes"],
        )

    return docs.mapInArrow(map_rows(run), "doc_id long, h long, sha binary, n_bytes long")


def directory(keyed: DataFrame, capacity: int = CAPACITY, depth: int = DEPTH) -> tuple[np.ndarray, int]:
    """The bucket of every prefix, and the directory's depth in bits (the hash's highest bits)."""
    n_parts = shuffle_partitions(keyed.sparkSession)
    once = keyed.groupBy("h").agg(F.max("n_bytes").alias("n_bytes"))
    prefix = F.shiftrightunsigned("h", 64 - depth)
    counted = once.groupBy(prefix.alias("p")).agg(F.sum("n_bytes").alias("n")).toArrow()  # at most 2^depth rows
    held = np.zeros(1 << depth, np.int64)
    held[counted.column("p").to_numpy()] = counted.column("n").to_numpy()
    capacity = max(1, min(capacity, int(held.sum()) // (8 * n_parts)))
    bits, buckets = 0, np.zeros(1, np.int64)
    splits = np.ones(1, bool)
    while bits < depth:
        size = held.reshape(1 << bits, -1).sum(1)
        whole = np.bincount(buckets, weights=size)
        splits = whole[buckets] > capacity
        if not splits.any():
            break
        # Double the directory; an overfull bucket's two halves part, the others stay shared.
        half = np.repeat(buckets, 2) * 2 + np.where(np.repeat(splits, 2), np.tile([0, 1], 1 << bits), 0)
        buckets = np.unique(half, return_inverse=True)[1]
        bits += 1
    return buckets.astype(np.int32), bits


class _Seen:
    """Texts that a scan task has sent, by hash, with the copies it met since."""

    def __init__(self):
        self.chains: dict[int, list[list]] = {}
        self.size = 0

    def more(self) -> list[tuple]:
        return [(h, e[1], None, e[2], e[3]) for h, chain in self.chains.items() for e in chain if e[2]]


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


ROW = "bucket int, h long, sha binary, body binary, n long, least long"
INDEX = "bucket int, h long, chain int, sha binary, keep_id long, group_size long"


def bucket_of(h: np.ndarray, buckets: np.ndarray, bits: int) -> np.ndarray:
    """The directory's entry for each hash."""
    return buckets[(h.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)]


def with_bucket(keyed: DataFrame, buckets: np.ndarray, bits: int) -> DataFrame:
    """keyed (a column h, narrow rows) with the bucket that the directory names."""
    held = keyed.sparkSession.sparkContext.broadcast(buckets)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = bucket_of(column(batch, "h").to_numpy(), held.value, bits)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "bucket"])

    return keyed.mapInArrow(map_rows(run), keyed.withColumn("bucket", F.lit(0)).schema)


def index(docs: DataFrame, buckets: np.ndarray, bits: int) -> DataFrame:
    """One row for each distinct text: bucket, h, chain (its number among texts of that hash), sha, keep_id, group_size."""
    held = docs.sparkSession.sparkContext.broadcast(buckets)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = held.value
        seen = _Seen()

        def rows(found: list[tuple]) -> pa.RecordBatch:
            h, sha, body, n, least = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(bucket_of(np.array(h, np.int64), where, bits)), pa.array(h, pa.int64()), pa.array(sha, pa.binary()), pa.array(body, pa.binary()), pa.array(n, pa.int64()), pa.array(least, pa.int64())], [x.split()[0] for x in ROW.split(", ")])

        for batch in batches:
            out = []
            for doc, raw in zip(column(batch, "doc_id").to_pylist(), text_bytes(batch), strict=True):
                text = normalise(raw)
                h = key_of(text)
                for e in seen.chains.get(h, ()):
                    if e[0] == text:
                        e[2] += 1
                        e[3] = _least(e[3], doc)
                        break
                else:
                    sha = hashlib.sha256(text).digest()
                    out.append((h, sha, text, 1, doc))
                    if seen.size > REMEMBER:
                        out += seen.more()
                        seen = _Seen()
                    seen.chains.setdefault(h, []).append([text, sha, 0, None])
                    seen.size += len(text) + 200
            if out:
                yield rows(out)
        if left := seen.more():
            yield rows(left)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, home, chain, counts, out = None, 0, [], {}, []

        def close() -> None:
            for k, (_, sha, n, least) in enumerate(chain):
                more, other = counts.get(sha, (0, None))
                out.append((home, now, k, sha, _least(least, other), n + more))

        def rows() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], [x.split()[0] for x in INDEX.split(", ")])

        for batch in batches:
            for bucket, h, sha, body, n, least in zip(*(column(batch, c).to_pylist() for c in ("bucket", "h", "sha", "body", "n", "least")), strict=True):
                if h != now:
                    close()
                    now, home, chain, counts = h, bucket, [], {}
                if body is None:
                    a, b = counts.get(sha, (0, None))
                    counts[sha] = (a + n, _least(b, least))
                    continue
                for e in chain:
                    if e[0] == body:
                        e[2], e[3] = e[2] + n, _least(e[3], least)
                        break
                else:
                    chain.append([body, sha, n, least])
            if len(out) > 10_000:
                yield rows()
                out.clear()
        close()
        if out:
            yield rows()

    n = shuffle_partitions(docs.sparkSession)
    return docs.mapInArrow(send, ROW).repartition(n, "bucket").sortWithinPartitions("bucket", "h").mapInArrow(own, INDEX)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, sha (of the normalised text)."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows = id_text(docs, id_col, text_col)
    keyed = scratch.table(keys(rows), "keys")
    buckets, bits = directory(keyed, capacity)
    found = scratch.table(index(rows, buckets, bits), "index")
    # A written table on either side: Spark can split the join where a group is hot.
    sought = scratch.table(with_bucket(keyed.drop("n_bytes"), buckets, bits), "sought")
    scratch.drop("keys")
    return sought.join(found.select("bucket", "h", "sha", "keep_id", "group_size"), ["bucket", "h", "sha"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha")
