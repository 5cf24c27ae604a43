"""Operator 3: best-fit packing of token sequences, certified by lower bounds.

``cut`` makes pieces of at most the capacity; ``pack`` gives each piece a sequence and a place in it.

Each partition packs by best fit decreasing. Dual feasible functions give a lower bound on the bins of its lengths
(volume, thresholds, and the step functions k = 1..32). A partition whose count equals its bound is certified: none
of its bins can be saved inside it, so it gives back only its emptiest bin. A partition with a gap gives back
its emptiest bins as well. What came back meets in fewer partitions and is packed again, round by round, until
one partition holds it.

Scale: pieces carry no text, only lengths and checksums; the texts are never shuffled. A partition's
rows are bounded by ``ROWS``; later rounds hold a bounded number of bins for each partition before.

Defined results: null or empty text gives one piece (the end id); repeated rows are packed as rows of their own; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, id_text, map_rows, shuffle_partitions
from .tokens import crc, encoder, with_ends

CAPACITY = 2048
#: Pieces that one partition packs, and bins that a partition gives back for each bin of its gap.
ROWS, BACK = 200_000, 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document's ids (with the end id); only documents longer than the capacity are cut."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = with_ends(*encoder(tokenizer).encode(column(batch, "text")), end_id)
        # Pieces, those of a document one after the other.
        n = -(-counts // capacity)
        of = np.repeat(np.arange(len(counts)), n)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        start, length = piece * capacity, np.minimum(counts[of] - piece * capacity, capacity)
        raw, at = memoryview(ids.astype("<u4").tobytes()), 4 * ((np.cumsum(counts) - counts)[of] + start)
        sums = [crc(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([column(batch, "doc_id").take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())], [x.split()[0] for x in PIECES.split(", ")])

    return id_text(docs, id_col, text_col).mapInArrow(map_rows(run), PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Least bins for lengths, by the best of three families of dual feasible functions."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    # Thresholds t: lengths over capacity - t count as whole bins, those under t as nothing.
    total, volume = np.cumsum(count), np.cumsum(count * x)
    t = np.arange(1, capacity // 2 + 1)
    large = total[-1] - total[capacity - t]
    middle = volume[capacity - t] - volume[t - 1]
    best = max(best, int((large - (-middle // capacity)).max()))
    for k in range(1, 33):
        exact = (k + 1) * x % capacity == 0
        up = np.where(exact, x * k, (k + 1) * x // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((count * up).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length its bin and offset; the room left in each bin."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if fits := mask >> need:
            room = need + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                mask ^= 1 << room
        else:
            b, room = len(left), capacity
            left.append(capacity)
        where[i], offset[i] = b, capacity - room
        left[b] = room = room - need
        if room:
            with_room[room].append(b)
            mask |= 1 << room
    return where, offset, np.array(left, np.int64)


def released(where: np.ndarray, left: np.ndarray, lengths: np.ndarray, capacity: int, back: int = BACK) -> np.ndarray:
    """Which bins a partition gives back: the emptiest ones, as many as its gap to the bound asks for."""
    gap = len(left) - lower_bound(lengths, capacity)
    free = np.zeros(len(left), bool)
    free[np.argsort(-left, kind="stable")[: 1 + back * gap]] = True
    return free & (left > 0)


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows: int = ROWS, scratch: Scratch | None = None) -> DataFrame:
    """pieces (doc_id, piece, length, any others) with sequence_id long and offset long."""
    spark = pieces.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    schema = pieces.schema
    out_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", sequence_id long, offset long"

    def run_round(k: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            table = pa.Table.from_batches(held)
            lengths = table.column("length").to_numpy().astype(np.int64)
            where, offset, left = best_fit_decreasing(lengths, capacity)
            first = (k << 56) + (TaskContext.get().partitionId() << 32)
            seq = first + where
            if not last and len(left):
                seq = np.where(released(where, left, lengths, capacity)[where], -1, seq)
            yield from table.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset)).to_batches(max_chunksize=50_000)

        return run

    todo, done = scratch.table(pieces, "pieces"), []
    for k in range(8):
        n = todo.count()
        parts = max(-(-n // rows), min(shuffle_partitions(spark), -(-n // 5_000)) if k == 0 else 1, 1)
        last = k > 0 and parts == 1 or k == 7
        # Dealt in turn, whatever the rows' ids: no partition holds more than its share.
        dealt = todo.repartition(parts)
        packed = scratch.table(dealt.mapInArrow(run_round(k, last), out_schema), f"round{k}")
        done.append(packed.filter("sequence_id >= 0"))
        if last:
            break
        todo = packed.filter("sequence_id < 0").select(*schema.names)
    scratch.drop("pieces")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut all documents and pack their pieces."""
    return pack(cut(docs, tokenizer, capacity, end_id, id_col, text_col), capacity)
