"""Operator 8: line dedup that returns compressed keep bitmaps.

Hashes of long enough line keys are dealt by ranges of (hash, document, position), with that order inside each
range, largest document first. A task streams its range: the first document of a hash keeps its lines, the next ones
wait until enough documents hold the line, then all but the first's are dropped. A hash cut by a range's edge (a very
common line, or one on very many rows of one id, spans ranges) passes its rows on, and so does one of which too many rows
wait; these are counted by partial aggregates and joined with the counts.

What comes back is, for each document that loses lines, a zlib-compressed bitmap (bit set: keep), not text.

Scale: only (hash, doc_id, row's key, position) of lines is shuffled, 36 bytes each; neither a hash nor a document must fit a task,
which holds ``HELD`` rows at most. Applying the bitmaps
joins them to the documents by doc_id.

Defined results: null or empty text is one empty line; rows without doc_id keep all lines and count for nothing; rows of
one doc_id count as one document, but each loses its own lines (its key is the text's hash); a repeated row is
treated like the first; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, id_text, map_rows, shuffle_partitions, text_bytes
from .words import LOWER

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Rows of a hash that wait in a task until enough documents hold it; if there are more, all its rows are passed on.
HELD = 2_000
SPACE = b" \t\n\r\x0b\x0c"
DROP, EDGE, COUNT = 0, 1, 2


def keyed_rows(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) with nk, which tells rows of one doc_id apart: the text's hash."""
    return rows.withColumn("nk", F.xxhash64(F.coalesce("text", F.lit(""))))


def line_keys(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """hi, lo (a key's 128-bit hash), doc_id, nk (the row's key), pos of every line with a long enough key."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        of, at, digests = [], [], []
        for row, raw in enumerate(text_bytes(batch)):
            for k, line in enumerate(raw.split(b"\n")):
                key = line.strip(SPACE)
                if len(key) >= least_chars and (key.isascii() or len(key.decode()) >= least_chars):
                    of.append(row)
                    at.append(k)
                    digests.append(xxhash.xxh3_128_digest(key.translate(LOWER)))
        hashes = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        rows = pa.array(of, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), column(batch, "doc_id").take(rows), column(batch, "nk").take(rows), pa.array(at, pa.int32())], ["hi", "lo", "doc_id", "nk", "pos"])

    return keyed_rows(docs.filter("doc_id is not null")).mapInArrow(map_rows(run), "hi long, lo long, doc_id long, nk long, pos int")


class _Run:
    """The rows of one hash, as they stream by."""

    def __init__(self, key: tuple[int, int], first: bool):
        self.key, self.first = key, first
        self.docs, self.now, self.top = 0, None, None
        self.passed_on = first
        self.held: list[tuple[int, int, int, int]] = []

    def add(self, doc: int, nk: int, pos: int, least_docs: int, out: list[tuple]) -> None:
        opens = self.now != doc
        if opens:
            self.now = doc
            self.docs += 1
            self.top = doc if self.top is None else self.top
        if self.passed_on:
            out.append((EDGE, *self.key, doc, nk, pos, int(opens)))
            return
        if self.docs < least_docs:
            self.held.append((doc, nk, pos, int(opens)))
            if len(self.held) > HELD:
                self._pass_on(out)
            return
        if self.held:
            out += [(DROP, *self.key, d, k, p, 0) for d, k, p, _ in self.held if d != self.top]
            self.held = []
        if doc != self.top:
            out.append((DROP, *self.key, doc, nk, pos, 0))

    def _pass_on(self, out: list[tuple]) -> None:
        out += [(EDGE, *self.key, *row) for row in self.held]
        self.held, self.passed_on = [], True

    def end(self, last: bool, out: list[tuple]) -> None:
        if not last or self.passed_on:
            return
        if self.held:
            self._pass_on(out)
        else:
            out.append((COUNT, *self.key, self.top, 0, 0, self.docs))


STREAM = "kind int, hi long, lo long, doc_id long, nk long, pos int, n int"


def stream(least_docs: int = LEAST_DOCS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Run | None = None
        any_run = False
        out: list[tuple] = []
        for batch in batches:
            hi, lo, doc, nk, pos = (column(batch, c).to_numpy() for c in ("hi", "lo", "doc_id", "nk", "pos"))
            if not len(hi):
                continue
            same = (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1])
            # Rows alone with their hash inside a batch can't reach the threshold and are passed over.
            need = np.concatenate(([True], same)) | np.concatenate((same, [True]))
            for k in np.flatnonzero(need).tolist():
                key = (int(hi[k]), int(lo[k]))
                if now is None or now.key != key:
                    if now:
                        now.end(False, out)
                    now = _Run(key, not any_run)
                    any_run = True
                now.add(int(doc[k]), int(nk[k]), int(pos[k]), least_docs, out)
            if len(out) > 20_000:
                yield _rows(out)
                out = []
        if now:
            now.end(True, out)
        if out:
            yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in STREAM.split(", ")])


def bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Per row that loses lines: doc_id, nk, n_dropped, keep (zlib-compressed bits; lines beyond its end stay)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lines")
    keyed = scratch.table(line_keys(id_text(docs, id_col, text_col), least_chars), "keys")
    order = (F.col("hi"), F.col("lo"), F.col("doc_id").desc(), F.col("nk"), F.col("pos"))
    ranged = keyed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    found = scratch.table(ranged.mapInArrow(stream(least_docs), STREAM), "found")
    scratch.drop("keys")
    # A document on both sides of an edge counts once.
    docs_of = found.filter(F.col("kind") != DROP).groupBy("hi", "lo", "doc_id").agg(F.max("n").alias("n"))
    edges = docs_of.groupBy("hi", "lo").agg(F.sum("n").alias("docs"), F.max("doc_id").alias("top")).filter(F.col("docs") >= least_docs)
    # Two hashes for each range, and one for HELD rows of few documents: how to join them is left to Spark.
    late = found.filter(F.col("kind") == EDGE).join(edges, ["hi", "lo"]).filter("doc_id <> top")
    drops = found.filter(F.col("kind") == DROP).select("doc_id", "nk", "pos").unionByName(late.select("doc_id", "nk", "pos"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, count = [], []
        for at in column(batch, "at").to_pylist():
            bits = np.ones(max(at) + 1, bool)
            bits[at] = False
            keep.append(zlib.compress(len(bits).to_bytes(8, "little") + np.packbits(bits).tobytes()))
            count.append(int(len(bits) - bits.sum()))
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "nk"), pa.array(count, pa.int64()), pa.array(keep, pa.binary())], ["doc_id", "nk", "n_dropped", "keep"])

    return drops.groupBy("doc_id", "nk").agg(F.collect_set("pos").alias("at")).mapInArrow(map_rows(run), "doc_id long, nk long, n_dropped long, keep binary")


def unpack(keep: bytes) -> np.ndarray:
    """A bitmap's bits."""
    raw = zlib.decompress(keep)
    return np.unpackbits(np.frombuffer(raw, np.uint8, offset=8), count=int.from_bytes(raw[:8], "little")).astype(bool)


def apply(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_text (UTF-8), kept_sha256."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], []]
        for raw, keep in zip(text_bytes(batch), column(batch, "keep").to_pylist(), strict=True):
            lines = raw.split(b"\n")
            n, lost = len(lines), 0
            if keep is not None:
                bits = unpack(keep)
                lines = [x for x, bit in zip(lines, bits.tolist(), strict=False) if bit] + lines[len(bits) :]
                lost = n - len(lines)
                raw = b"\n".join(lines)
            for to, v in zip(cols, (n, lost, raw, hashlib.sha256(raw).hexdigest()), strict=True):
                to.append(v)
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True))], ["doc_id", "n_lines", "n_dropped", "kept_text", "kept_sha256"])

    # The bitmaps grow with the documents: never a broadcast, however few they are.
    return keyed_rows(id_text(docs, id_col, text_col)).join(kept.select("doc_id", "nk", "keep").hint("merge"), ["doc_id", "nk"], "left").mapInArrow(map_rows(run), "doc_id long, n_lines long, n_dropped long, kept_text binary, kept_sha256 string")
