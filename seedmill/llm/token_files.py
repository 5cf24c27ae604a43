"""Operator 1: token-id files, compressed by a Re-Pair grammar per shard.

``write_tokens`` encodes every text, appends an end id and writes shards in ascending doc_id order;
``read_tokens`` decodes them all; ``read_some`` decodes chosen documents by ``decode_range``, without the rest of their shards.

A shard is a row of a Parquet table in the shared folder: its documents' ids and token counts, and a grammar.
Re-Pair replaces frequent adjacent pairs by new symbols again and again. Here each pass replaces all pairs at or
above a count that falls from pass to pass (the most frequent pairs first), and goes on at the least count until
no pair reaches it: passes over arrays instead of one priority-queue step for each pair. Rules are stored with their expansion lengths, so a binary
search over summed lengths finds any position.

Scale: documents are dealt by ranges of doc_id (one shuffle of the texts; many rows of one doc_id span ranges), every task
streams its range and holds one shard. A range's tokens before it are known from one sum for each range; nothing else goes to the driver.

Defined results: null text is empty (only the end id); null doc_ids come first; equal doc_ids are kept as rows of
their own, ordered by their texts' hash; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count as count_up

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, column, id_text
from .tokens import crc, encoder, ragged, with_ends

SHARD_TOKENS = 1 << 20
#: The least count of a pair that is replaced.
LEAST = 6
SHARD = "part int, shard int, start_in_part long, n_tokens long, doc_ids array<bigint>, doc_tokens array<bigint>, base long, width int, rules binary, rule_lengths binary, symbols binary"


def _every_other(at: np.ndarray) -> np.ndarray:
    """Of each run of neighbouring places the first, third and so on."""
    fresh = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
    return (np.arange(len(at)) - np.repeat(fresh, np.diff(np.append(fresh, len(at))))) & 1 == 0


def repair(ids: np.ndarray, base: int, passes: int | None = None, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grammar of ids (all below base): symbols, rules (pairs; rule k makes symbol base + k), expansion lengths.

    It ends when no pair reaches the least count, or after so many passes if given.
    """
    seq = ids.astype(np.int64)
    rules: list[np.ndarray] = []
    lengths = np.empty(0, np.int64)
    made = base
    todo: np.ndarray | None = None
    for k in count_up() if passes is None else range(passes):
        if len(seq) < 2:
            break
        floor = max(least, len(ids) >> (10 + 2 * k))
        if todo is None:
            key = (seq[:-1] << 32) | seq[1:]
            slot = ((key * np.int64(-7046029254386353131)) >> 45) & 0x7FFFF
            often = np.flatnonzero(np.bincount(slot, minlength=1 << 19)[slot] >= floor)
            key = key[often]
        else:
            often, key = todo, (seq[todo] << 32) | seq[todo + 1]
        kind, pairs = pd.factorize(key)
        count = np.bincount(kind, minlength=len(pairs))
        frequent = count[kind] >= floor
        at, kind = often[frequent], kind[frequent]
        places = at
        if not len(at):
            if floor == least:
                break
            continue
        # Of overlapping places every other one is replaced, counted from the start of each run of them.
        own = _every_other(at)
        used = np.bincount(kind[own], minlength=len(pairs))
        own &= used[kind] >= max(2, least // 2)
        if own.any():
            at, kind = at[own], kind[own]
        else:
            # Pairs that overlap left too few of each: the most frequent one is replaced alone.
            at = at[kind == np.argmax(count)]
            at = at[_every_other(at)]
            kind = np.full(len(at), np.argmax(count))
        kinds, name = np.unique(kind, return_inverse=True)
        pair = pairs[kinds]
        left, right = pair >> 32, pair & 0xFFFFFFFF
        size = np.concatenate((np.ones(0, np.int64), lengths))
        grown = [np.where(s < base, 1, size[np.maximum(s - base, 0)] if len(size) else 1) for s in (left, right)]
        rules.append(np.stack((left, right), 1))
        lengths = np.concatenate((lengths, grown[0] + grown[1]))
        seq[at] = made + name
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        if floor == least:
            # From now on only pairs with a symbol just made, or that were frequent before, can be frequent.
            now = np.cumsum(keep) - 1
            near = np.concatenate((now[at] - 1, now[at], now[places[keep[places]]]))
            todo = np.unique(near[(near >= 0) & (near < len(seq) - 1)])
        made += len(kinds)
    return seq, np.concatenate(rules) if rules else np.empty((0, 2), np.int64), lengths


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for, replaced level by level."""
    seq = symbols
    while len(seq) and (high := seq >= base).any():
        out = np.repeat(seq, 1 + high)
        at = np.flatnonzero(high) + np.arange(int(high.sum()))
        pair = rules[seq[high] - base]
        out[at], out[at + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq


def expand_all(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The same for a whole shard: every rule is expanded once, then looked up."""
    flat = np.concatenate((np.arange(base), expand(base + np.arange(len(rules)), rules, base)))
    size = np.concatenate((np.ones(base, np.int64), lengths))
    return ragged(flat, (np.cumsum(size) - size)[symbols], size[symbols])


def decode_range(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of a shard, from only the symbols that reach into that stretch."""
    size = np.where(symbols < base, 1, lengths[np.maximum(symbols - base, 0)] if len(lengths) else 1)
    ends = np.cumsum(size)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    before = int(ends[a - 1]) if a else 0
    return expand(symbols[a:b], rules, base)[start - before : stop - before]


def _shard(part: int, shard: int, start: int, docs: list, counts: np.ndarray, ids: np.ndarray, base: int) -> pa.RecordBatch:
    symbols, rules, lengths = repair(ids, base)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    kind = f"<u{width}"
    values = [part, shard, start, len(ids), docs, counts.tolist(), base, width, rules.astype(kind).tobytes(), lengths.astype("<u4").tobytes(), symbols.astype(kind).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, SHARD_TYPES, strict=True)], SHARD_NAMES)


SHARD_NAMES = [x.split()[0] for x in SHARD.split(", ")]
SHARD_TYPES = [{"int": pa.int32(), "long": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "binary": pa.binary()}[x.split()[1]] for x in SHARD.split(", ")]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode all texts and write their shards to path, in ascending doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        base = max(enc.size, end_id + 1)
        part, shard, start, n = TaskContext.get().partitionId(), 0, 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            docs, counts, ids = zip(*held, strict=True)
            held.clear()
            return _shard(part, shard, start, [d for some in docs for d in some], np.concatenate(counts), np.concatenate(ids), base)

        for batch in batches:
            ids, counts = with_ends(*enc.encode(column(batch, "text")), end_id)
            names, ends, a = column(batch, "doc_id").to_pylist(), np.cumsum(counts), 0
            while a < len(names):
                before = int(ends[a] - counts[a])
                b = min(len(names), int(np.searchsorted(ends, before + shard_tokens - n)) + 1)
                held.append((names[a:b], counts[a:b], ids[before : ends[b - 1]]))
                n += int(ends[b - 1]) - before
                a = b
                if n >= shard_tokens:
                    yield close()
                    shard, start, n = shard + 1, start + n, 0
        if held:
            yield close()

    # Ranges go on by the text's hash and by row, so that many rows of one doc_id, even equal ones, span ranges.
    rows = id_text(docs, id_col, text_col).withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = (F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("_row"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order[:2], "text")
    ranged.select("doc_id", "text").mapInArrow(run, SHARD).write.mode("overwrite").parquet(path)


def _starts(shards: DataFrame) -> DataFrame:
    """Ids before each range of doc_id, by one sum for each: as many rows as the writer had tasks."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    before, at = [], 0
    for row in sorted(totals, key=lambda r: r.part):
        before.append((row.part, at))
        at += row.n
    return shards.sparkSession.createDataFrame(before, "part int, before long")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def _read(wanted: bool):
    """Decodes shards: all their documents, or only those at the places that the column wanted names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda name: column(batch, name)[k]  # noqa: E731, B023
                kind, base = f"<u{get('width').as_py()}", get("base").as_py()
                symbols = np.frombuffer(get("symbols").as_buffer(), kind).astype(np.int64)
                rules = np.frombuffer(get("rules").as_buffer(), kind).astype(np.int64).reshape(-1, 2)
                lengths = np.frombuffer(get("rule_lengths").as_buffer(), "<u4").astype(np.int64)
                docs, counts = get("doc_ids").values, get("doc_tokens").values.to_numpy()
                ends = np.cumsum(counts)
                begin = ends - counts
                if wanted:
                    at = np.sort(get("wanted").values.to_numpy())
                    docs, counts, begin, ends = docs.take(pa.array(at)), counts[at], begin[at], ends[at]
                    pieces = [decode_range(symbols, rules, lengths, base, a, b).astype("<u4").tobytes() for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                else:
                    raw = expand_all(symbols, rules, lengths, base).astype("<u4").tobytes()
                    pieces = [raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                first = get("before").as_py() + get("start_in_part").as_py()
                yield pa.RecordBatch.from_arrays([docs, pa.array(begin + first), pa.array(counts), pa.array([crc(x) for x in pieces], pa.int64()), pa.array(pieces, pa.binary())], [x.split()[0] for x in READ.split(", ")])

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (little-endian 32-bit)."""
    shards = spark.read.schema(SHARD).parquet(path)
    # One row for each task of the writer.
    return shards.join(F.broadcast(_starts(shards)), "part").mapInArrow(_read(False), READ)


def read_some(path: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The same for the documents that wanted names, by random access.

    Places come from the files' doc_id column alone; of each shard that holds some, only the stretches of ids asked for are decoded,
    found by their rules' expansion lengths.
    """
    shards = wanted.sparkSession.read.schema(SHARD).parquet(path)
    ids = wanted.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    places = shards.select("part", "shard", F.posexplode("doc_ids").alias("at", "doc_id")).join(ids, "doc_id", "left_semi")
    held = places.groupBy("part", "shard").agg(F.collect_list(F.col("at").cast("long")).alias("wanted"))
    return shards.join(held, ["part", "shard"]).join(F.broadcast(_starts(shards)), "part").mapInArrow(_read(True), READ)


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files and read them back."""
    scratch = Scratch(docs.sparkSession, "tokens")
    write_tokens(docs, scratch.path("shards"), tokenizer, end_id, id_col, text_col)
    return read_tokens(docs.sparkSession, scratch.path("shards"))
