"""Operator 5: SimHash near-dedup by multi-index hashing.

A fingerprint is two segments of 32 bits. Two fingerprints within 4 bits agree up to 2 bits in one of them, so the
balls of radius 1 around both segments' values meet in some value. Each distinct fingerprint is entered under all values
of the two balls (66 rows); rows that meet in the table are verified on all 64 bits. Links become components by
alternating stars.

Scale: only distinct fingerprints enter the index, so exact copies, however many, are one entry. Buckets come
sorted and are streamed: small ones are compared by shifted arrays; larger ones grow components from pivots, which
scan only what no pivot has reached, and yield a spanning forest instead of all pairs. A bucket beyond ``HOT`` is not
held but passed on and dealt out as pairs of blocks to many tasks. Nothing about documents goes to the driver.

Defined results: null or empty texts have fingerprint zero and link like any other; fewer words than a shingle are one
shingle; rows without doc_id take part, component_id is the least non-null doc_id (null if there is none); repeated rows stay
rows; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, id_text, map_rows, shuffle_partitions, text_bytes
from .components import components
from .words import LOWER

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Fingerprints that one bucket holds in a task; and up to which size pairs are compared by shifts.
HOT, SMALL = 20_000, 48


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles (XXH64, repeats included)."""
    parts = raw.translate(LOWER).split()
    if not parts:
        return 0
    if len(parts) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    n = len(parts) - shingle + 1
    h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip((end - size)[:n].tolist(), end[shingle - 1 :].tolist(), strict=True)], np.uint64, n)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        ones += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in text_bytes(batch)], np.uint64)
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(map_rows(run), "doc_id long, fp long")


ENTRY = "key long, flip int, fp long"


def _enter(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The 66 entries of each fingerprint; flip: 0, or 1 + the bit that was changed."""
    fp = column(batch, "fp").to_numpy().view(np.uint64)
    halves = np.stack((fp & np.uint64(0xFFFFFFFF), (fp >> np.uint64(32)) | np.uint64(1 << 32)), 1)
    flips = np.concatenate(([0], 1 << np.arange(32))).astype(np.uint64)
    keys = (halves[:, :, None] ^ flips).ravel().view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(np.arange(33, dtype=np.int32), 2 * len(fp))), pa.array(np.repeat(fp.view(np.int64), 66))], ["key", "flip", "fp"])


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= distance


def _forest(fps: np.ndarray, distance: int, other: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected within fps (with other: by links between the two)."""
    out = []
    rest = np.unique(fps if other is None else np.concatenate((fps, other)))
    queue: list[int] = []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        pivot = np.int64(queue.pop())
        near = _near(rest, pivot, distance)
        if near.any():
            found = rest[near]
            out.append((np.full(len(found), pivot), found))
            queue += found.tolist()
            rest = rest[~near]
    return out


def _links(key: np.ndarray, flip: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole buckets, given sorted by key."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    found = []
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    k, f, p = key[small], flip[small], fp[small]
    for d in range(1, SMALL):
        same = np.flatnonzero(k[d:] == k[:-d])
        if not len(same):
            break
        # With one bit changed alike in both, they meet in that segment's own value as well.
        same = same[(f[same] != f[same + d]) | (f[same] == 0)]
        same = same[_near(p[same], p[same + d], distance)]
        found.append((p[same], p[same + d]))
    for a, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        found += _forest(fp[a : a + n], distance)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


MET = "hot boolean, a long, b long"


def _meet(distance: int, hot: int):
    """Streams buckets; gives links (hot false: a, b) and the entries of too large buckets (hot true: key, fp)."""

    def out(is_hot: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        if not is_hot and len(a):
            both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
            a, b = both[:, 0], both[:, 1]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), is_hot)), pa.array(a), pa.array(b)], ["hot", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, flip, fp = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)
        passing: int | None = None
        for batch in batches:
            k, f, p = (column(batch, c).to_numpy() for c in ("key", "flip", "fp"))
            if passing is not None:
                more = k == passing
                if more.any():
                    yield out(True, k[more], p[more])
                k, f, p = k[~more], f[~more], p[~more]
                if not len(k):
                    continue
                passing = None
            key, flip, fp = np.concatenate((key, k)), np.concatenate((flip, f)), np.concatenate((fp, p))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            if last:
                done = out(False, *_links(key[:last], flip[:last], fp[:last], distance))
                if done.num_rows:
                    yield done
                key, flip, fp = key[last:], flip[last:], fp[last:]
            if len(key) > hot:
                passing = int(key[0])
                yield out(True, key, fp)
                key, flip, fp = key[:0], flip[:0], fp[:0]
        if len(key):
            done = out(False, *_links(key, flip, fp, distance))
            if done.num_rows:
                yield done

    return run


def _hot_links(entries: DataFrame, distance: int, hot: int) -> DataFrame:
    """Links within the buckets that are too large for a task, as pairs of blocks."""
    entries = entries.select(F.col("a").alias("key"), F.col("b").alias("fp")).distinct()
    blocks = entries.groupBy("key").agg(F.ceil(F.count("*") / (hot // 4)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = entries.join(blocks, "key").withColumn("own", mine).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            cols = [column(batch, c).to_numpy() for c in ("key", "i", "j", "fp")]
            marks = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0))))
            for a, b in zip(marks.tolist(), [*marks[1:].tolist(), batch.num_rows], strict=True):
                name = tuple(int(c[a]) for c in cols[:3])
                if name != now:
                    yield from close(held)
                    now, held = name, []
                held.append(cols[3][a:b])
        yield from close(held)

    def close(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if held and (found := _forest(np.concatenate(held), distance)):
            a, b = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    n = shuffle_partitions(entries.sparkSession)
    return pairs.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, scratch: Scratch, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all that lie within distance of each other."""
    if distance > 4:
        raise ValueError("balls of radius 1 in two segments find distances up to 4")
    n = shuffle_partitions(distinct.sparkSession)
    entered = distinct.select("fp").mapInArrow(map_rows(_enter), ENTRY)
    met = scratch.table(entered.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_meet(distance, hot), MET), "met")
    found = met.filter("not hot").select("a", "b")
    if met.filter("hot").limit(1).count():
        found = found.unionByName(_hot_links(met.filter("hot"), distance, hot))
    return found


def groups(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fp, component_id (the least doc_id that links reach)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.table(fingerprints(id_text(docs, id_col, text_col), shingle), "fingerprints")
    distinct = scratch.table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, scratch, distance), scratch)
    labelled = scratch.table(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "labelled")
    scratch.keep("fingerprints", "labelled")
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.join(smallest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
