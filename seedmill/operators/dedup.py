"""Exact, batch-wise, greedy multi-key and near dedup."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b, md5
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .graph import components
from .saved import saved


def exact(rows: DataFrame, text: str, id_col: str) -> DataFrame:
    """Distinct texts with their least id; a partial and a final aggregate."""
    return rows.groupBy(text).agg(F.min(id_col).alias(id_col))


def by_batch(rows: DataFrame, text: str, id_col: str, pos: str, batch: int = 250) -> DataFrame:
    """Within each batch of positions, one row for each SHA-1 (the last one, as a dictionary would keep)."""
    keyed = rows.withColumns({"batch_id": F.floor(F.col(pos) / batch).cast("long"), "sha1": F.sha1(text)})
    return keyed.groupBy("batch_id", "sha1").agg(F.max(id_col).alias(id_col))


def greedy(rows: DataFrame, keys: list[Column], rank: list[Column], id_col: str, rounds: int = 200) -> DataFrame:
    """Ids that a pass in rank order keeps, where a row is dropped if any of its keys belongs to a row kept before.

    All keys share one space. The result is the lexicographically first maximal independent set of the conflict graph: in
    each round a row that is first in rank on all its keys stays, rows that share a key with it go, and their other
    keys become free. Rows with a null key are left out. Each round is a table in the shared folder.
    """
    order = F.struct(*(c.alias(f"r{k}") for k, c in enumerate([*rank, F.col(id_col)])))
    todo = rows.select(F.col(id_col), order.alias("rank"), F.array_distinct(F.array(*keys)).alias("keys")).filter(~F.exists("keys", lambda k: k.isNull()))
    kept: DataFrame | None = None
    for _ in range(rounds):
        todo = saved(todo)
        if not todo.limit(1).count():
            break
        pairs = todo.select(id_col, "rank", F.explode("keys").alias("key"))
        first = pairs.groupBy("key").agg(F.min("rank").alias("first"))
        judged = pairs.join(first, "key").groupBy(id_col).agg(F.min((F.col("rank") == F.col("first")).cast("int")).alias("wins"))
        won = saved(judged.filter("wins = 1").select(id_col))
        taken = pairs.join(won, id_col, "left_semi").select("key").distinct()
        lost = pairs.join(taken, "key", "left_semi").select(id_col).distinct()
        todo = todo.join(lost, id_col, "left_anti")
        kept = won if kept is None else kept.unionByName(won)
    else:
        raise RuntimeError(f"greedy dedup did not settle in {rounds} rounds")
    return kept if kept is not None else rows.select(id_col).limit(0)


# Near dedup: MinHash over word shingles, banded.

PRIME = (1 << 31) - 1


def coefficients(permutations: int) -> list[tuple[int, int]]:
    """Pairs (a, b) of the hash family (a * h + b) mod PRIME, by a linear congruence."""
    out, x = [], 12345
    for _ in range(permutations):
        pair = []
        for _ in range(2):
            x = (x * 1103515245 + 12345) % PRIME
            pair.append(x or 1)
        out.append((pair[0], pair[1]))
    return out


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct shingles of words (lower case, split at spaces and line ends); a shorter text is one shingle."""
    words = F.filter(F.split(F.lower(text), "[ \\n]+", -1), lambda w: w != "")
    n = F.size(words)
    # Shifted copies side by side: what stands inside of a lambda would be computed again for each element.
    shifted = F.arrays_zip(*(F.slice(words, k + 1, F.greatest(n - size + 1, F.lit(0))).alias(f"w{k}") for k in range(size)))
    joined = F.transform(shifted, lambda x: F.concat_ws(" ", *(x[f"w{k}"] for k in range(size))))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < size, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(joined))


#: Hashes whose permutations are taken at once.
SOME = 1 << 15


def _least(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each permutation (a, b) over the hashes."""
    return np.min([((h[k : k + SOME, None] * a + b) % PRIME).min(axis=0) for k in range(0, len(h), SOME)], axis=0)


def _by_row(rows: DataFrame, id_col: str, held: str, permutations: int, hashes: Callable[[pa.Array], Iterator[np.ndarray]]) -> DataFrame:
    """(id, sig) of each row that has hashes, where the row is: neither hashes nor least values are shuffled."""
    a, b = (np.array(x, np.int64) for x in zip(*coefficients(permutations), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(hashes(batch.column(1)))
            some = pa.array([len(h) > 0 for h in found], pa.bool_())
            sigs = np.concatenate([np.empty(0, np.int64), *(_least(h, a, b) for h in found if len(h))])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sigs) + 1, permutations), pa.int32()), pa.array(sigs, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(some), lists], [id_col, "sig"])

    return rows.select(id_col, held).mapInArrow(run, StructType([rows.schema[id_col], StructField("sig", ArrayType(LongType()))]))


def signatures(rows: DataFrame, text: str, id_col: str, permutations: int = 32, size: int = 5) -> DataFrame:
    """(id, sig): the least hash of each permutation over the shingles; texts without words have none. A shingle's hash is 28 bits of its MD5."""

    def hashes(texts: pa.Array) -> Iterator[np.ndarray]:
        for t in texts:
            words = [w for w in (t.as_py() or b"").replace(b"\n", b" ").split(b" ") if w]
            # A shingle is a slice of the words in one text, from a word's start to the end of its last.
            raw, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
            starts = [0, *ends]
            digests = [md5(raw[starts[k] : ends[min(k + size, len(ends)) - 1] - 1], usedforsecurity=False).digest()[:4] for k in range(min(len(ends), max(len(ends) - size + 1, 1)))]
            yield (np.frombuffer(b"".join(digests), ">u4") >> 4).astype(np.int64)

    return _by_row(rows.select(id_col, F.lower(text).cast("binary").alias("_text")), id_col, "_text", permutations, hashes)


def set_signatures(sets: DataFrame, permutations: int) -> DataFrame:
    """(id, sig) from sets (id, s) of 64-bit hashes, by their upper 31 bits; texts are not split again."""

    def hashes(arrays: pa.Array) -> Iterator[np.ndarray]:
        at, values = arrays.offsets.to_numpy(), arrays.values.to_numpy()
        for k in range(len(arrays)):
            yield (values[at[k] : at[k + 1]].view(np.uint64) >> np.uint64(33)).astype(np.int64)

    return _by_row(sets, "id", "s", permutations, hashes)


def banding(threshold: float, recall: float = 0.98, permutations: int = 64) -> tuple[int, int]:
    """(bands, rows per band): the most rows under which a pair at the threshold shares a band with at least this probability."""
    for r in range(permutations, 0, -1):
        if 1 - (1 - threshold**r) ** (permutations // r) >= recall:
            return permutations // r, r
    raise ValueError("no banding reaches the recall with so few permutations")


def banded(sigs: DataFrame, id_col: str, bands: int, rows_per_band: int) -> DataFrame:
    """(id, band): each signature's bands as text."""
    parts = F.array(*(F.concat(F.lit(f"{k}:"), F.array_join(F.transform(F.slice("sig", k * rows_per_band + 1, rows_per_band), lambda x: x.cast("string")), ",")) for k in range(bands)))
    return sigs.select(F.col(id_col).alias("id"), F.explode(parts).alias("band"))


def candidates(held: DataFrame) -> DataFrame:
    """Pairs (a, b): the least id of each band with every other one of it; as many as there are entries at most."""
    first = held.groupBy("band").agg(F.min("id").alias("a"))
    return held.join(first, "band").filter("id <> a").select("a", F.col("id").alias("b")).distinct()


#: Members of a band that are compared pair by pair; those of larger ones are joined on rare shingles.
HOT = 1_000


def crossing(held: DataFrame, classes: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) that share a band but no class (node, root); members, as id and root, of the bands that are too large for that).

    Bands with one class only, however large, are passed over.
    """
    known = held.join(classes.withColumnRenamed("node", "id"), "id", "left").select("id", "band", F.coalesce("root", "id").alias("root"))
    mixed = known.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("k")).filter("low <> high").select("band", "k")
    some = saved(known.join(mixed, "band"))
    small = some.filter(F.col("k") <= hot)
    left, right = small.select(F.col("id").alias("a"), "band", F.col("root").alias("ra")), small.select(F.col("id").alias("b"), "band", F.col("root").alias("rb"))
    return left.join(right, "band").filter("a < b and ra <> rb").select("a", "b").distinct(), some.filter(F.col("k") > hot).select("id", "root").distinct()


def jaccard(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with the similarity of their sets (id, s)."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("similarity"))


def verified(pairs: DataFrame, of: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """pairs (a, b) at the threshold or above with their similarity; only the sets of ids that are in a pair are dealt out."""
    pairs = saved(pairs)
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    return jaccard(pairs, of(ids)).filter(F.col("similarity") >= threshold)


def distinct_texts(rows: DataFrame, text: str, id_col: str, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows as id and digest; each digest once with rep, its least id, and the text): copies, however many, are one.

    The second one is written if it is read more than once (keep).
    """
    # Null texts are copies of each other too, and of no other text.
    keyed = rows.select(F.col(id_col), F.coalesce(F.sha2(F.lower(text), 256), F.lit("")).alias("digest"), F.col(text))
    once = keyed.groupBy("digest").agg(F.min(id_col).alias("rep"), F.min(text).alias(text))
    return keyed.select(id_col, "digest"), saved(once) if keep else once


#: Bytes of texts whose words are taken at once; longer words are hashed one by one.
PIECE, LONG = 1 << 22, 256


def _mixed(h: np.ndarray) -> np.ndarray:
    """Each bit of the hashes over all of its bits; one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each word (its place and size in raw, which eight more bytes end), eight bytes at a time."""
    eights = np.ndarray(len(raw) - 7, np.uint64, raw, 0, (1,))
    h, at = sizes.astype(np.uint64), 0
    for k in np.flatnonzero(sizes > LONG).tolist():
        h[k] = int.from_bytes(blake2b(raw[starts[k] : starts[k] + sizes[k]], digest_size=8).digest(), "little")
    live = np.flatnonzero(sizes <= LONG)
    while len(live):
        left = sizes[live] - at
        some = eights[starts[live] + at] & (np.uint64(2**64 - 1) >> (8 * np.maximum(8 - left, 0)).astype(np.uint64))
        h[live] = _mixed(h[live] ^ some)
        live, at = live[left > 8], at + 8
    return h


def _shingle_hashes(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The distinct shingles' hashes of each text in lower case."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.zeros(edges[-1] - edges[0] + 8, np.uint8)
    raw[:-8] = np.frombuffer(data, np.uint8, edges[-1] - edges[0], edges[0]) if data else 0
    edges = edges - edges[0]
    word = (raw[:-8] != 32) & (raw[:-8] != 10)
    # A word starts after a separator or where its text does.
    first, last = np.concatenate([[True], ~word]), np.concatenate([~word, [True]])
    first[edges] = last[edges] = True
    starts = np.flatnonzero(word & first[:-1])
    h = _word_hashes(raw, starts, np.flatnonzero(word & last[1:]) + 1 - starts)
    ends = np.searchsorted(starts, edges)
    full = h[: max(len(h) - size + 1, 0)]
    for k in range(1, size):
        full = _mixed(full) + h[k : k + len(full)]
    full = _mixed(full)
    for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if end - start >= size:
            x = np.sort(full[start : end - size + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        else:
            # A shorter text is one shingle, told from longer ones by its number of words.
            short = h[start : min(start + 1, end)]
            for k in range(start + 1, end):
                short = _mixed(short) + h[k]
            yield _mixed(_mixed(short) + np.uint64(end - start))


def hashed_shingles(once: DataFrame, text: str, size: int) -> DataFrame:
    """(id, s): 64-bit hashes of each distinct text's shingles, made of their words' hashes, so that no shingle is built as a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(ends // PIECE)) + 1).tolist(), len(ends)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                found = list(_shingle_hashes(batch.column(1).slice(start, end - start), size))
                at = pa.array([0, *accumulate(map(len, found))], pa.int32())
                values = pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.ListArray.from_arrays(at, values)], ["id", "s"])

    texts = once.select(F.col("rep").alias("id"), F.lower(text).alias("_text"))
    return texts.mapInArrow(run, StructType([texts.schema["id"], StructField("s", ArrayType(LongType()))]))


def some_sets(once: DataFrame, text: str, size: int, ids: DataFrame) -> DataFrame:
    """hashed_shingles of the texts that ids (id) name; it is the texts that are shuffled, which are smaller than their hashes."""
    return saved(hashed_shingles(once.join(ids.select(F.col("id").alias("rep")).distinct(), "rep", "left_semi"), text, size))


def near(rows: DataFrame, text: str, id_col: str, threshold: float = 0.8, size: int = 5, bands: int | None = None, rows_per_band: int | None = None, hot: int = HOT) -> DataFrame:
    """(id, component): near-duplicate classes, exact unless a banding is given.

    Equal texts, nulls included, are one member from the start. Each band's members are compared to its least one; the links found
    make classes, so a large group of near copies costs one comparison for each member and band. Then all texts of different
    classes are joined exactly, on rare shingles that several classes hold: what no band brings together is found there.

    With a given banding, only pairs that share a band are compared: a second pass compares those pairs of a band that lie in
    different classes. Bands that more than ``hot`` members of several classes share are not compared pair by pair: their members
    are joined exactly, on shingles that several classes hold.
    """
    given = bands is not None and rows_per_band is not None
    if not given:
        bands, rows_per_band = banding(threshold)
    keyed, once = distinct_texts(rows, text, id_col)
    sets = lambda ids: some_sets(once, text, size, ids)
    # Bands are known by a hash here: one that collides adds a pair that is then verified.
    shingled = hashed_shingles(once, text, size) if given else saved(hashed_shingles(once, text, size))
    bare = banded(set_signatures(shingled, bands * rows_per_band), "id", bands, rows_per_band)
    held = saved(bare.withColumn("band", F.xxhash64("band")))
    similar = lambda pairs: saved(verified(pairs, sets, threshold).select("a", "b"))
    links = similar(candidates(held))
    roots = components(links)
    if given:
        pairs, members = crossing(held, roots, hot)
        more = similar(pairs)
        members = saved(members)
        if members.limit(1).count():
            # A band of many dissimilar texts: pairs that are no match never meet.
            more = more.unionByName(saved(similar_sets(sets(members), threshold, members).select("a", "b")))
    else:
        members = saved(once.select(F.col("rep").alias("id")).join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root")))
        more = saved(similar_sets(shingled, threshold, members).select("a", "b"))
    if more.limit(1).count():
        roots = components(links.unionByName(more))
    classes = once.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("component"))
    return keyed.join(classes, "digest").select(id_col, "component")


def similar_pairs(rows: DataFrame, text: str, id_col: str, threshold: float = 0.5, size: int = 3) -> DataFrame:
    """(a, b, similarity) of all pairs of distinct texts (by their least ids) at the threshold or above; exact.

    Two sets at the threshold share a shingle among the first few of each, in an order that puts rare ones first; so
    pairs meet on rare shingles, and a shingle that most texts hold brings none together.
    """
    _, once = distinct_texts(rows, text, id_col, keep=False)
    return similar_sets(hashed_shingles(once, text, size), threshold)


#: Sets that meet on a shingle pair by pair; where more do, they are compared block by block.
OFTEN = 64
#: Sets of a block, and shingles of a block, on the average.
SIDE, SIDE_SHINGLES = 512, 1 << 18
#: Shingles that a block's matrix holds at once.
WIDTH = 4096


def similar_sets(sets: DataFrame, threshold: float, classes: DataFrame | None = None, often: int = OFTEN, side: int = SIDE) -> DataFrame:
    """(a, b, similarity) of sets (id, s) at the threshold or above; with classes (id, root) only of sets in different ones.

    Sets that meet on a shingle of few sets are paired by a join. A family of near copies meets on each of its many common
    shingles: those of more than ``often`` sets bring blocks of sets together instead, once, and two blocks are compared at once.
    """
    able = shareable(sets, threshold)
    able = saved(able.withColumn("root", F.col("id")) if classes is None else able.join(classes, "id"))
    least = lambda share, n: F.ceil(share * n - 1e-9)
    # The first shingle that two sets share leaves each as many, itself included, as they share at most: left.
    # The larger set of a pair shares the threshold of itself; the smaller one more of itself, so fewer places of it can be the first.
    both = threshold / (1 + threshold)
    heads = able.select("id", "n", "root", F.size("o").alias("of"), F.slice("o", F.lit(1), (F.size("o") - least(threshold, F.col("n")) + 1).cast("int")).alias("head"))
    first = heads.select("id", "n", "root", "of", F.posexplode("head").alias("at", "x")).select("id", "n", "root", "x", (F.col("of") - F.col("at")).alias("left"))
    meeting = Window.partitionBy("x")
    first = first.withColumns({"met": F.count("*").over(meeting), "low": F.min("root").over(meeting), "high": F.max("root").over(meeting)})
    first = first.filter("low <> high").withColumn("small", F.col("left") >= least(2 * both, F.col("n")))
    first = saved(first.drop("low", "high"))
    blocks, cells = blocked(first.filter(F.col("met") > often), side)
    large, small = (first.filter(F.col("met") <= often).select("x", "small", *(F.col(c).alias(f"{c}_{at}") for c in ("id", "n", "left", "root"))) for at in ("l", "s"))
    met = large.drop("small").join(small.filter("small").drop("small"), "x").filter("n_s < n_l or n_s = n_l and id_s < id_l").filter("root_s <> root_l")
    met = met.filter(F.least("left_s", "left_l") >= least(both, F.col("n_s") + F.col("n_l")))
    pairs = met.select(F.least("id_s", "id_l").alias("a"), F.greatest("id_s", "id_l").alias("b")).distinct()
    for c in ("a", "b"):
        pairs = pairs.join(blocks.select(F.col("id").alias(c), F.col("block").alias(f"block_{c}")), c, "left")
    # What lies in two blocks that are compared is found there; a set without a block (null, which least() would pass over) lies in none.
    known = F.col("block_a").isNotNull() & F.col("block_b").isNotNull()
    pairs = pairs.withColumns({"p": F.when(known, F.least("block_a", "block_b")), "q": F.greatest("block_a", "block_b")}).join(cells, ["p", "q"], "left_anti").select("a", "b")
    return paired(pairs, able, threshold).unionByName(compared(cells, blocks, able, threshold))


def _complete(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by a key, in tables that hold all rows of their keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(key).to_numpy(zero_copy_only=False)
        # The last key may go on in the next batch.
        cut = np.flatnonzero(values[1:] != values[:-1]) + 1
        if held and len(values) and held[-1].column(key)[-1].as_py() != values[0]:
            cut = np.append(0, cut)
        if len(cut):
            yield pa.Table.from_batches([*held, batch.slice(0, int(cut[-1]))]).combine_chunks()
            held = []
        if (rest := batch.slice(int(cut[-1]) if len(cut) else 0)).num_rows:
            held.append(rest)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


#: Bits by which shingles are dealt out, and shingles that are dealt out at once.
PART_BITS, DEALT = 12, 1 << 20


def shareable(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, n, o) of sets (id, s): the size and, rare ones first, the members that another set holds too; without sets that hold too few of those.

    Members are dealt out many to a row, by their first bits, and counted where they meet.
    """
    kind = sets.schema["id"].dataType

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // DEALT)) + 1).tolist(), len(sizes)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                x, n = batch.column(1).slice(start, end - start).flatten().to_numpy(), sizes[start:end]
                part = (x.view(np.uint64) >> np.uint64(64 - PART_BITS)).astype(np.uint16)
                order = np.argsort(part, kind="stable")
                of, part = np.repeat(np.arange(len(n)), n)[order], part[order]
                starts = np.flatnonzero(np.diff(part, prepend=-1))
                at = pa.array(np.append(starts, len(x)), pa.int32())
                ids = batch.column(0).slice(start, end - start).take(pa.array(of))
                lists = [pa.ListArray.from_arrays(at, values) for values in (ids, pa.array(n[of], pa.int32()), pa.array(x[order]))]
                yield pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int32()), *lists], ["part", "id", "n", "x"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _complete(batches, "part"):
            ids, n, x = (rows.column(c).combine_chunks().flatten() for c in ("id", "n", "x"))
            order = np.argsort(x.to_numpy())
            x = x.to_numpy()[order]
            times = np.diff(np.flatnonzero(np.diff(x)) + 1, prepend=0, append=len(x))
            k = np.repeat(times, times)
            # Members of one set only come first in every order, and can't be shared.
            order, x, k = pa.array(order[k > 1]), x[k > 1], k[k > 1]
            yield pa.RecordBatch.from_arrays([ids.take(order), n.take(order), pa.array(x), pa.array(k, pa.int64())], ["id", "n", "x", "k"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _complete(batches, "id"):
            ids, n, k, x = (rows.column(c).to_numpy() for c in ("id", "n", "k", "x"))
            starts = np.append(0, np.flatnonzero(ids[1:] != ids[:-1]) + 1)
            ends = np.append(starts[1:], len(ids))
            able = np.flatnonzero(ends - starts >= np.ceil(threshold * n[starts] - 1e-9))
            # What is left is all that two sets can share, so it tells their similarity.
            found = [x[a:b][np.lexsort((x[a:b], k[a:b]))] for a, b in zip(starts[able].tolist(), ends[able].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *found])))
            yield from rows.select(["id", "n"]).take(pa.array(starts[able])).append_column("o", lists).combine_chunks().to_batches()

    columns = [StructField("id", kind), StructField("n", IntegerType())]
    many = [StructField(c, ArrayType(t)) for c, t in (("id", kind), ("n", IntegerType()), ("x", LongType()))]
    parts = sets.select("id", "s").mapInArrow(dealt, StructType([StructField("part", IntegerType()), *many]))
    shared = parts.repartition("part").sortWithinPartitions("part").mapInArrow(counted, StructType([*columns, StructField("x", LongType()), StructField("k", LongType())]))
    return shared.repartition("id").sortWithinPartitions("id").mapInArrow(gathered, StructType([*columns, StructField("o", ArrayType(LongType()))]))


def blocked(often: DataFrame, side: int) -> tuple[DataFrame, DataFrame]:
    """(blocks (id, block) of sets that meet on common shingles; cells (p, q) of blocks in which two sets may meet), from (id, n, root, x, met, small).

    The sets of a block share its shingle: the one of each set that most sets meet on.
    """
    of = often.groupBy("id", "n", "root").agg(F.max(F.struct("met", "x"))["x"].alias("group"))
    parts = of.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / side, F.sum("n") / SIDE_SHINGLES)).alias("parts"))
    blocks = saved(of.join(parts, "group").select("id", "root", F.xxhash64("group", F.pmod(F.xxhash64("id"), "parts")).alias("block")))
    roots = blocks.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    held = often.select("id", "x", "small").join(blocks, "id").groupBy("x", "block").agg(F.max("small").alias("small")).join(roots, "block")
    large, small = (held.select("x", "small", *(F.col(c).alias(f"{c}_{at}") for c in ("block", "low", "high"))) for at in ("l", "s"))
    met = large.drop("small").join(small.filter("small").drop("small"), "x").filter("least(low_l, low_s) <> greatest(high_l, high_s)")
    cells = met.select(F.least("block_l", "block_s").alias("p"), F.greatest("block_l", "block_s").alias("q")).distinct()
    return blocks.select("id", "block"), saved(cells)


def paired(pairs: DataFrame, able: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b) at the threshold or above with their similarity, from (id, n, o)."""
    one, other = (able.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("o").alias(f"o_{c}")) for c in ("a", "b"))
    both = pairs.join(one, "a").join(other, "b")
    shared = F.size(F.array_intersect("o_a", "o_b"))
    return both.select("a", "b", (shared / (F.col("n_a") + F.col("n_b") - shared)).alias("similarity")).filter(F.col("similarity") >= threshold)


def compared(cells: DataFrame, blocks: DataFrame, able: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) at the threshold or above of all sets of two blocks (p, q), from (id, n, root, o); a task holds two blocks at a time."""
    spark, kind = able.sparkSession, able.schema["id"].dataType

    def run(cell: pa.Table) -> pa.Table:
        ids, n, roots = (cell[c].to_numpy() for c in ("id", "n", "root"))
        one = np.flatnonzero(cell["first"].to_numpy())
        other = np.flatnonzero(~cell["first"].to_numpy())
        same = not len(other)
        other = one if same else other
        held = cell["o"].combine_chunks()
        _, codes = np.unique(held.flatten().to_numpy(), return_inverse=True)
        rows = np.repeat(np.arange(len(ids)), pc.list_value_length(held).to_numpy())
        # Only what both sides hold gets a column.
        counts = [np.bincount(codes[np.isin(rows, x)], minlength=codes.max() + 1) for x in (one, other)]
        needed = counts[0] > 1 if same else (counts[0] > 0) & (counts[1] > 0)
        some = needed[codes]
        column, rows = (np.cumsum(needed) - 1)[codes[some]], rows[some]
        order = np.argsort(column, kind="stable")
        column, rows = column[order], rows[order]
        shared = np.zeros((len(one), len(other)))
        for start in range(0, int(needed.sum()), WIDTH):
            part = slice(*np.searchsorted(column, [start, start + WIDTH]))
            bits = np.zeros((len(ids), WIDTH), np.float32)
            bits[rows[part], column[part] - start] = 1
            shared += bits[one] @ bits[other].T
        similarity = shared / (n[one][:, None] + n[other][None, :] - shared)
        found = (similarity >= threshold) & (roots[one][:, None] != roots[other][None, :])
        if same:
            found &= ids[one][:, None] < ids[other][None, :]
        left, right = np.nonzero(found)
        a, b = ids[one[left]], ids[other[right]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": similarity[found]})

    # Each block's sets, once for each cell of it.
    sides = cells.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
    members = blocks.join(able, "id").join(sides, "block").select("p", "q", "id", "n", "root", "o", (F.col("block") == F.col("p")).alias("first"))
    # Two blocks cost far more than their bytes tell, so Spark is not to join partitions here.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    schema = StructType([StructField("a", kind), StructField("b", kind), StructField("similarity", DoubleType())])
    return members.repartition(parts, "p", "q").groupBy("p", "q").applyInArrow(run, schema)


def assert_unique(rows: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once; must be empty."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")
