"""Operator 2: removal of long repeated strings, by suffix arrays from two-stage sorting.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else is removed, exactly.

1. Anchors. In each window of LENGTH bytes the rightmost least hash of its grams (half as long) is its anchor. Equal
   windows have equal anchors at equal places, so repeats can only meet at anchors with equal grams; there
   are about two for each gram length of text, and all others are never looked at again.
2. An anchor's context is all that windows around it reach. Contexts that occur twice are removed whole. What is left
   are contexts that occur once but share their gram: the edges of repeats.
   Of these, contexts whose windows' common cores all occur once are dropped as well.
3. The other contexts' bytes go to tasks by gram. A task joins them to one text and sorts the suffixes that start a window in
   two stages: suffixes smaller than their successors are sorted directly, the others are induced by scans of the buckets.
   Adjacent suffixes with a common prefix of LENGTH are repeats (of different places).
4. A gram with more than ``HOT`` such contexts would not fit a task. Its windows are halved, which makes their common core a
   longer key, until no more than HOT contexts share a key; they are sorted like the others. Halves that only one context
   has are dropped, and of contexts equal in a whole half one stays; so what is still hot when nothing is left to halve is one window.

Equal contexts are told by two hashes, 64 bits of the gram and 128 of the context: of a hot gram's contexts there may be more than
64 bits tell apart. A hash that differs proves a difference, so all that hashes drop is dropped rightly.

Scale: the large shuffles are of anchors (about 1/100 of the bytes in number), counted by partial aggregates, and of
the texts, twice, for joins by doc_id that Spark splits where they are skewed.

Defined results: null is empty; texts shorter than LENGTH lose nothing; repeated rows are copies of each other; a row is known by
its doc_id and its text's hash, so rows of one doc_id (or of none) with different texts are documents of their own; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, id_text, map_rows, shuffle_partitions, text_bytes

LENGTH = 400
#: Contexts of one gram that go to one task; bytes that are sorted at once; bytes of a long text that are hashed at once.
HOT, SORT_BYTES, PIECE = 300, 1 << 18, 1 << 20
#: Never part of UTF-8.
END = 0xFF


# Two-stage suffix sorting.


def is_smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor (the last one is not)."""
    n = len(text)
    sign = np.zeros(n, np.int8)
    sign[:-1] = np.where(text[:-1] < text[1:], 1, np.where(text[:-1] > text[1:], -1, 0))
    sign[-1] = -1
    at = np.where(sign != 0, np.arange(n), n)
    return sign[np.minimum.accumulate(at[::-1])[::-1]] > 0


def sort_directly(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """places in the order of their suffixes' first depth bytes."""
    raw = text.tobytes()
    keys = [raw[p : p + depth] for p in places.tolist()]
    return places[sorted(range(len(keys)), key=keys.__getitem__)] if keys else places


def suffix_array(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted suffixes (a mask) of text (uint8), in the order of their first depth bytes at least."""
    small = is_smaller(text)
    # To induce a suffix takes its successors, up to the first that is smaller than its own.
    at = np.arange(len(text))
    last_small = np.concatenate(([-1], np.maximum.accumulate(np.where(small, at, -1))[:-1]))
    last_wanted = np.maximum.accumulate(np.where(wanted, at, -1))
    need = (last_wanted >= 0) & (last_small < last_wanted)
    ordered = sort_directly(text, np.flatnonzero(need & small), depth)
    cuts = np.searchsorted(text[ordered], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[-1]].append(np.array([len(text) - 1]))
    out = []

    def send(found: np.ndarray) -> None:
        found = found[np.argsort(text[found], kind="stable")]
        first = text[found]
        for part in np.split(found, np.flatnonzero(first[1:] != first[:-1]) + 1) if len(found) else ():
            induced[text[part[0]]].append(part)

    def before(found: np.ndarray) -> np.ndarray:
        found = found[found > 0] - 1
        return found[need[found] & ~small[found]]

    for c in range(256):
        now = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        while len(now):
            out.append(now)
            found = before(now)
            own = text[found] == c
            send(found[~own])
            now = found[own]
        now = ordered[cuts[c] : cuts[c + 1]]
        if len(now):
            out.append(now)
            send(before(now))
    order = np.concatenate(out)
    return order[wanted[order]]


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes at a and b have a common prefix of length bytes at least."""
    padded = np.concatenate((text, np.zeros(8, np.uint8))).tobytes()
    word = np.ndarray((len(text),), "<u8", padded, 0, (1,))
    same = np.ones(len(a), bool)
    live = np.arange(len(a))
    for k in [*range(0, length - 8, 8), max(length - 8, 0)]:
        live = live[word[a[live] + k] == word[b[live] + k]]
    same[:] = False
    same[live] = True
    return same


def repeats(contexts: list[bytes], places: list[tuple[int, int]], starts: list[tuple[int, int]], length: int) -> list[tuple[int, int, int]]:
    """(context, first, last) start of windows that occur at another place too.

    places: (document, offset) of contexts; starts: the first and last window of each that count.
    """
    size = np.array([len(c) for c in contexts], np.int64)
    text = np.frombuffer(bytes([END]).join(contexts) + bytes([END]), np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    edge = np.zeros(len(text) + 1, np.int32)
    first, last = np.array(starts, np.int64).T
    np.add.at(edge, begin + first, 1)
    np.add.at(edge, begin + last + 1, -1)
    order = suffix_array(text, np.cumsum(edge[:-1]) > 0, length)
    if not len(order):
        return []
    of = np.repeat(np.arange(len(size)), size + 1)
    linked = common(text, order[:-1], order[1:], length)
    heads = np.flatnonzero(np.concatenate(([True], ~linked)))
    offset = np.array([p[1] for p in places], np.int64)
    spot = (np.array([p[0] for p in places], np.int64)[of[order]] << 40) + offset[of[order]] + order - begin[of[order]]
    twice = np.minimum.reduceat(spot, heads) != np.maximum.reduceat(spot, heads)
    hit = order[np.repeat(twice, np.diff(np.append(heads, len(order))))]
    hit.sort()
    which = of[hit]
    first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1]))) if len(hit) else np.empty(0, np.int64)
    last = np.append(first[1:], len(hit)) - 1
    return [(k, a, b) for k, a, b in zip(which[first].tolist(), (hit[first] - begin[which[first]]).tolist(), (hit[last] - begin[which[last]]).tolist(), strict=True)] if len(hit) else []


# Anchors.

_BASE = 0x9E3779B97F4A7C15


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours."""
    n = len(v) - w + 1
    rows = np.concatenate((v, np.full(-len(v) % w, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    left = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(rows, axis=1).ravel()
    return np.minimum(left[:n], right[w - 1 : w - 1 + n])


def anchors(pieces: list[tuple[bytes, int, int]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces (bytes, first and end of the window starts that count): piece, place and gram hash of the anchors."""
    gram = length // 2
    size = np.array([len(p[0]) for p in pieces], np.int64)
    begin = np.cumsum(size) - size
    text = np.frombuffer(b"".join(p[0] for p in pieces), np.uint8)
    n = len(text)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none
    room = 1 << max(21, n.bit_length())
    power, inverse = _powers(room)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[:n])))
    h = (total[gram:] - total[:-gram]) * inverse[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    low = np.uint64((1 << 24) - 1)
    rank = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    least = _least(rank, length - gram + 1)
    edge = np.zeros(len(least) + 1, np.int8)
    for (raw, a, b), at in zip(pieces, begin.tolist(), strict=True):
        b = min(b, len(raw) - length + 1)
        if a < b:
            edge[at + a] += 1
            edge[at + b] -= 1
    least = least[np.cumsum(edge[:-1]) > 0]
    if not len(least):
        return none, none, none
    pick = np.unique((low - (least & low)).astype(np.int64))
    of = np.searchsorted(begin, pick, "right") - 1
    return of, pick - begin[of], h[pick].view(np.int64)


ANCHOR = "g long, c long, d long, doc_id long, nk long, pos int"


def _anchor_rows(length: int):
    reach = length - length // 2

    def flush(pieces: list, meta: list, out: list[list]) -> None:
        of, at, g = anchors(pieces, length)
        for k, p, h in zip(of.tolist(), at.tolist(), g.tolist(), strict=True):
            doc, nk, base, done = meta[k]
            if base + p <= done[0]:
                continue
            done[0] = base + p
            raw = pieces[k][0]
            left, right = min(p, reach), min(len(raw) - p, length)
            c, d = struct.unpack("<qq", xxhash.xxh3_128_digest(raw[p - left : p + right], seed=left))
            for to, v in zip(out, (h, c, d, doc, nk, base + p), strict=True):
                to.append(v)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(6)]
        pieces, meta, held = [], [], 0
        for doc, nk, raw in zip(column(batch, "doc_id").to_pylist(), column(batch, "nk").to_pylist(), text_bytes(batch), strict=True):
            done = [-1]
            for a in range(0, len(raw) - length + 1, PIECE) if len(raw) >= length else ():
                # Wide enough for the contexts of all anchors of the windows that start in a .. a + PIECE.
                base = max(0, a - 2 * length)
                part = raw[base : a + PIECE + 3 * length] if len(raw) > PIECE else raw
                pieces.append((part, a - base, a - base + PIECE))
                meta.append((doc, nk, base, done))
                held += len(part)
                if held >= PIECE:
                    flush(pieces, meta, out)
                    pieces, meta, held = [], [], 0
        if pieces:
            flush(pieces, meta, out)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (*(pa.int64(),) * 5, pa.int32()), strict=True)], [x.split()[0] for x in ANCHOR.split(", ")])

    return map_rows(run)


# Contexts.

CONTEXT = "g long, m long, n long, doc_id long, nk long, pos int, lo int, body binary, cores array<bigint>"
#: Parts of the windows around an anchor; each part's core is what all its windows share.
PARTS = 4
SPAN = "doc_id long, nk long, first int, last int"


def _cut_contexts(length: int):
    reach = length - length // 2
    parts = [(reach * k // PARTS, reach * (k + 1) // PARTS) for k in range(PARTS)]

    def cores(g: int, p: int, body: bytes) -> list[int]:
        """Hashes of the cores of those parts of which the context holds a window."""
        low, high = max(0, p + length - len(body)), min(reach, p)
        return [xxhash.xxh3_64_intdigest(body[p - a : p - b + length], seed=(g ^ a) & 0xFFFFFFFFFFFFFFFF) - (1 << 63) for a, b in parts if max(a, low) <= min(b, high)]

    done: tuple[int, int] | None = None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal done
        out: list[list] = [[] for _ in range(9)]
        for doc, nk, raw, wanted in zip(column(batch, "doc_id").to_pylist(), column(batch, "nk").to_pylist(), text_bytes(batch), column(batch, "wanted").to_pylist(), strict=True):
            # Equal rows follow each other out of the join; the first one's contexts are all that is wanted.
            if (doc, nk) == done:
                continue
            done = doc, nk
            for w in wanted:
                p = w["pos"]
                lo = max(0, p - reach)
                body = raw[lo : p + length]
                for to, v in zip(out, (w["g"], w["m"], w["n"], doc, nk, p, lo, body, cores(w["g"], p - lo, body)), strict=True):
                    to.append(v)
        kinds = (pa.int64(),) * 5 + (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], [x.split()[0] for x in CONTEXT.split(", ")])

    return map_rows(run)


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "nk", "first", "last"])


def _sorted_repeats(length: int, sort_bytes: int):
    """Streams contexts, those of a key together; gives the spans of repeated windows."""

    def close(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        name: dict[tuple, int] = {}
        places = [(name.setdefault(h[1:3], len(name)), h[3]) for h in held]
        found = [(held[k][1], held[k][2], held[k][3] + a, held[k][3] + b + length) for k, a, b in repeats([h[4] for h in held], places, [h[5:] for h in held], length)]
        if found:
            yield _spans(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(column(batch, c).to_pylist() for c in ("key", "doc_id", "nk", "lo", "body", "head", "tail")), strict=True):
                if size >= sort_bytes and row[0] != held[-1][0]:
                    yield from close(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) + 1
        yield from close(held)

    return run


def _halved(length: int):
    """Adds the hashes of a part of windows (offsets a..b before the anchor): all its bytes, and what its windows share.

    Near a text's ends only the offsets low..high exist. A context that lacks some of a part has its core all the
    same (it lies in every window of the part), but the whole is then like no other's.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole, core = [], []
        for row in zip(*(column(batch, c).to_pylist() for c in ("g", "doc_id", "nk", "pos", "lo", "body", "a", "b", "low", "high")), strict=True):
            g, doc, nk, pos, lo, body, a, b, low, high = row
            p = pos - lo
            seed = (g ^ (a << 32) ^ b) & 0xFFFFFFFFFFFFFFFF
            core.append(xxhash.xxh3_128_digest(body[p - a : p - b + length], seed=seed))
            whole.append(xxhash.xxh3_128_digest(body[p - b : p - a + length], seed=seed) if low <= a and b <= high else f"{doc} {nk} {pos}".encode())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(core, pa.binary()), pa.array(whole, pa.binary())], [*batch.schema.names, "core", "whole"])

    return map_rows(run)


SORT = ("key", "doc_id", "nk", "lo", "body", "head", "tail")


def _starts(df: DataFrame, key: Column) -> DataFrame:
    """What the sorting task reads: contexts under a key, with the first and last start of their windows a..b before the anchor."""
    place = F.col("pos") - F.col("lo")
    return df.withColumns({"key": key, "head": (place - F.least("b", "high")).cast("int"), "tail": (place - F.greatest("a", "low")).cast("int")}).select(*SORT)


def _split_hot(now: DataFrame, length: int, hot: int, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """Contexts of grams with many of them, by halving: (what to sort, under longer keys; spans of windows that are equal as a key).

    One context of each repeated part stays as a witness for those that share only some of its windows.
    """
    columns = now.columns
    to_sort, found = [], []
    for k in range(length.bit_length() + 1):
        hashed = scratch.table(now.mapInArrow(_halved(length), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in now.schema) + ", core binary, whole binary"), f"half{k}")
        whole = hashed.groupBy("core", "whole").agg(F.sum("n").alias("n_whole"), F.count("*").alias("rows"), F.min(F.struct("doc_id", "nk", "pos")).alias("witness"))
        core = whole.groupBy("core").agg(F.sum("n_whole").alias("n_core"), F.sum("rows").alias("rows"), F.min("n_whole").alias("least"))
        judged = scratch.table(hashed.join(whole.drop("rows"), ["core", "whole"]).join(core.filter("n_core > 1"), "core").drop("whole"), f"judged{k}")
        scratch.drop(f"half{k}")
        to_sort.append(_starts(judged.filter(F.col("rows") <= hot), F.xxhash64("core")))
        large = judged.filter(F.col("rows") > hot)
        place = F.col("pos") - F.least("b", "high"), F.col("pos") - F.greatest("a", "low") + length
        found.append(large.filter("n_whole > 1").select("doc_id", "nk", place[0].cast("int").alias("first"), place[1].cast("int").alias("last")))
        more = large.filter((F.col("least") == 1) & (F.col("a") < F.col("b")) & (F.col("witness") == F.struct("doc_id", "nk", "pos"))).withColumn("n", F.col("n_whole"))
        if not more.limit(1).count():
            break
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("b").alias("b"))))
        now = more.withColumn("half", halves).withColumns({"a": F.col("half.a"), "b": F.col("half.b")}).filter("a <= high and b >= low").select(*columns)
    return to_sort, found


def removals(docs: DataFrame, length: int = LENGTH, hot: int = HOT, sort_bytes: int = SORT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, spans (byte ranges to remove), kept (the other bytes)."""
    spark = docs.sparkSession
    if length < 16:
        raise ValueError("length must be 16 bytes or more")
    scratch = Scratch(spark, "suffixes")
    reach = length - length // 2
    # A row's key: its doc_id, and its text's hash; the hash's last bit tells rows without doc_id.
    digest = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(-2)).bitwiseOR(F.col("doc_id").isNull().cast("long"))
    rows = id_text(docs, id_col, text_col).withColumn("nk", digest).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    all_anchors = scratch.table(rows.mapInArrow(_anchor_rows(length), ANCHOR), "anchors")
    # Written, so that joins deal both sides out by themselves and Spark can split a hot gram.
    shared = scratch.table(all_anchors.groupBy("g").agg(F.count("*").alias("k")).filter("k > 1").select("g"), "shared")
    met = scratch.table(all_anchors.join(shared, "g"), "met")
    scratch.drop("anchors", "shared")
    contexts = scratch.table(met.groupBy("g", "c", "d").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "nk", "pos")).alias("at")), "contexts")
    twice = met.join(contexts.filter("n > 1").select("g", "c", "d"), ["g", "c", "d"]).select("doc_id", "nk", F.greatest(F.lit(0), F.col("pos") - reach).cast("int").alias("first"), (F.col("pos") + length).cast("int").alias("last"))
    # Grams with several contexts, one of them met only once: the edges of repeats.
    edges = scratch.table(contexts.groupBy("g").agg(F.count("*").alias("m"), F.min("n").alias("least")).filter("m > 1 and least = 1").select("g", "m"), "edges")
    wanted = contexts.join(edges, "g").select("at.doc_id", "at.nk", F.struct("g", "m", "n", "at.pos").alias("w")).groupBy("doc_id", "nk").agg(F.collect_list("w").alias("wanted"))
    cut = scratch.table(rows.join(wanted.hint("merge"), ["doc_id", "nk"]).mapInArrow(_cut_contexts(length), CONTEXT), "cut")
    # A context none of whose cores occurs again shares its gram, but no window.
    held = cut.select("g", "doc_id", "nk", "pos", "n", F.explode("cores").alias("core"))
    again = scratch.table(held.groupBy("core").agg(F.sum("n").alias("k")).filter("k > 1").select("core"), "again")
    live = held.join(again.hint("merge"), "core", "left_semi").select("g", "doc_id", "nk", "pos").distinct()
    low = F.greatest(F.lit(0), F.col("pos") + length - F.col("lo") - F.octet_length("body")).cast("int")
    high = F.least(F.lit(reach), F.col("pos") - F.col("lo")).cast("int")
    ranges = {"low": low, "high": high, "a": F.lit(0), "b": F.lit(reach)}
    bodies = scratch.table(cut.drop("cores").join(live.hint("merge"), ["g", "doc_id", "nk", "pos"], "left_semi").withColumns(ranges).filter("low <= high"), "bodies")
    scratch.drop("cut", "again")
    to_sort, spans = [_starts(bodies.filter(F.col("m") <= hot), F.col("g"))], [twice]
    if bodies.filter(F.col("m") > hot).limit(1).count():
        more, equal = _split_hot(bodies.filter(F.col("m") > hot).drop("m"), length, hot, scratch)
        to_sort, spans = to_sort + more, spans + equal
    dealt = reduce(DataFrame.unionByName, to_sort).repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")
    # A table of its own, so that Spark can split the join of a hot context in the stage that gathers the spans.
    spans.append(scratch.table(dealt.mapInArrow(_sorted_repeats(length, sort_bytes), SPAN), "sorted"))
    per_doc = scratch.table(reduce(DataFrame.unionByName, spans).groupBy("doc_id", "nk").agg(F.collect_set(F.struct("first", "last")).alias("found")), "spans")
    scratch.keep("spans")
    schema = "doc_id long, n_bytes long, spans array<struct<first:bigint,last:bigint>>, kept binary"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes, merged, kept = [], [], [], []
        for doc, nk, raw, found in zip(column(batch, "doc_id").to_pylist(), column(batch, "nk").to_pylist(), text_bytes(batch), column(batch, "found").to_pylist(), strict=True):
            out: list[dict] = []
            for f in sorted((f["first"], min(f["last"], len(raw))) for f in found or ()):
                if out and f[0] <= out[-1]["last"]:
                    out[-1]["last"] = max(out[-1]["last"], f[1])
                else:
                    out.append({"first": f[0], "last": f[1]})
            at, parts = 0, []
            for s in out:
                parts.append(raw[at : s["first"]])
                at = s["last"]
            parts.append(raw[at:])
            for to, v in zip((ids, sizes, merged, kept), (None if nk & 1 else doc, len(raw), out, b"".join(parts)), strict=True):
                to.append(v)
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(merged, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return rows.join(per_doc.hint("merge"), ["doc_id", "nk"], "left").mapInArrow(map_rows(run), schema)
