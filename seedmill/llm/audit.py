"""Operator 13: how filters act together, in every order.

Each document becomes a mask: one bit for each filter that it fails. Documents are counted per part and mask (a cell), so an audit
of all orders reads 2^5 cells of a part, not its documents. The orders of a part are visited by adjacent transpositions: each
swaps two neighbours, after which only these two steps are counted anew from the cells; the walk adds up what each filter
removes, which gives its Shapley sum.

Scale: one scan makes narrow rows (id, part, 128-bit hash of the text, mask), which are counted before they are shuffled. Copies
are found by the least doc_id of each hash, a partial aggregate, joined back on hash and doc_id, so a text that a third of
all rows hold is no hot key; rows without doc_id are dealt by their text's hash when labels are joined, and one doc_id on many
rows is left to Spark's split of skewed joins. Parts are audited side by side, a row of cells for each.

Defined results: null text is empty; null part is the empty string; rows of one doc_id count one by one and are no copies of each
other; rows without doc_id have no label and are never copies, nor do others count as copies of theirs; a doc_id labelled
twice counts as good or toxic if any label says so; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, map_rows, text_bytes

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 50, 65, 5
UPPER, JUNK = bytes(range(65, 91)), b"#$%&*|"
CELLS = 1 << len(FILTERS)
COUNTS = ("n", "good", "toxic")


def mask(raw: bytes) -> int:
    """The bits of A to D that a text fails."""
    words = raw.split()
    n_chars = len(raw) if raw.isascii() else len(raw.decode())
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * (len(raw) - len(raw.translate(None, UPPER))) > MOST_UPPER * n_chars) << 2
        | (len(raw.translate(None, JUNK)) < len(raw)) << 3
    )


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per row: doc_id, part, hi, lo (the text's hash), mask (A to D)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_bytes(batch)
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), ">i8").astype(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "part"), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(list(map(mask, texts)), pa.int32())], ["doc_id", "part", "hi", "lo", "mask"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    return rows.mapInArrow(map_rows(run), "doc_id long, part string, hi long, lo long, mask int")


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per part that has rows, and mask: n, good, toxic."""
    scratch = Scratch(docs.sparkSession, "audit")
    counted = masks(docs, id_col, text_col, part_col).groupBy("doc_id", "part", "hi", "lo", "mask").agg(F.count("*").alias("n"))
    rows = scratch.table(counted, "rows")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), *((F.col(c) == 1).alias(to) for c, to in (("quality", "is_good"), ("toxic", "is_toxic")))).filter("doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("is_good").alias("is_good"), F.max("is_toxic").alias("is_toxic"))
    # The second key deals rows without doc_id out; labels have none.
    labelled = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.col("lo")).otherwise(0)).join(known.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left").drop("spread")
    first = rows.filter("doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    # Neither side may be a broadcast: both grow with the documents.
    flagged = labelled.join(first.hint("merge"), ["hi", "lo", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(copy, 1 << 4).otherwise(0))
    found = flagged.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(f"is_{c}"), F.col("n")).otherwise(0)).alias(c) for c in COUNTS[1:]))
    found = scratch.table(found, "cells")
    scratch.keep("cells")
    return found


def transpositions(n: int) -> Iterator[int]:
    """The places k whose items (k, k + 1) are swapped to visit all n! orders, each once (every item sweeps through the rest)."""
    if n < 2:
        return
    down = True
    for inner in [*transpositions(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if inner is not None:
            yield inner + (1 if down else 0)
        down = not down


def walk(cube: np.ndarray) -> Iterator[tuple[list[int], np.ndarray]]:
    """All orders of the filters with (3 counts, step, part) of what each step removes, for cube (3, masks, parts); one array, changed in place."""
    n = len(FILTERS)
    every = np.arange(CELLS)
    order = list(range(n))
    removed = np.zeros((len(COUNTS), n, cube.shape[2]), np.int64)

    def count(step: int) -> None:
        before = sum(1 << f for f in order[:step])
        removed[:, step] = cube[:, (every & before == 0) & (every >> order[step] & 1 == 1)].sum(axis=1)

    for step in range(n):
        count(step)
    yield order, removed
    for k in transpositions(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        count(k)
        count(k + 1)
        yield order, removed


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _audit(parts: list[str], cube: np.ndarray) -> pa.RecordBatch:
    n = len(FILTERS)
    every = np.arange(CELLS)
    total = cube[0].sum(axis=0)
    fails = np.stack([cube[0, every >> f & 1 == 1].sum(axis=0) for f in range(n)])
    unique = np.stack([cube[0, 1 << f] for f in range(n)])
    shapley = np.zeros_like(fails)
    names, orders, rows = [], [], []
    for order, removed in walk(cube):
        shapley[order] += removed[0]
        names.append("".join(FILTERS[f] for f in order))
        orders.append(list(order))
        # (step, part) of each column
        rows.append((total - removed[0].cumsum(axis=0), removed[0].copy(), fails[order] - removed[0], unique[order], removed[1].copy(), removed[2].copy()))
    size, n_orders = n * len(parts), len(rows)
    flat = [np.stack([r[c] for r in rows]).reshape(-1) for c in range(6)]
    sums = np.stack([shapley[o] for o in orders]).reshape(-1)
    part = pa.array(parts, pa.string()).take(pa.array(np.tile(np.arange(len(parts)), n * n_orders)))
    name = pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(n_orders), size)))
    step = pa.array(np.tile(np.repeat(np.arange(1, n + 1), len(parts)), n_orders), pa.int32())
    return pa.RecordBatch.from_arrays([part, name, step, *map(pa.array, flat), pa.array(sums)], [c.split()[0] for c in AUDIT.split(", ")])


def audit(found: DataFrame) -> DataFrame:
    """Per part, order of filters and step: the columns of AUDIT, from cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                own = batch.slice(a, 64)
                cube = np.zeros((len(COUNTS), CELLS, own.num_rows), np.int64)
                for p, counts in enumerate(column(own, "counts").to_pylist()):
                    for c in counts:
                        cube[:, c["mask"], p] = [c[k] for k in COUNTS]
                yield _audit(column(own, "part").to_pylist(), cube)

    # At most 32 cells for each part.
    rows = found.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("counts"))
    return rows.mapInArrow(run, AUDIT)
