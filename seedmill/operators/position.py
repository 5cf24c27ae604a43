"""Order as data: positions, slices, resuming, chunks, seeded shuffles, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .saved import saved


def with_pos(rows: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """Positions 0..n-1 in the order of the columns.

    Rows are sorted by range and numbered inside each partition; only the partitions' counts meet, so no task sees all
    rows (a window over everything would).
    """
    if not order:
        raise ValueError("a stable order needs columns")
    kept = rows.columns
    ranged = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = counts.select("_part", "_first", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").select(*kept, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name))


def take(rows: DataFrame, start: int, n: int | None, pos: str = "pos") -> DataFrame:
    """Positions start .. start + n; a start beyond the end gives no rows."""
    out = rows.filter(F.col(pos) >= start)
    return out if n is None else out.filter(F.col(pos) < start + n)


def resume(rows: DataFrame, done: DataFrame, key: str = "seed", done_pos: str = "out_pos", pos: str = "pos", legacy: bool = False) -> DataFrame:
    """The rows still to do.

    By default those whose key is not in the output, so rows that failed are tried again. legacy: those after the last
    written key, whatever failed before it.
    """
    if not legacy:
        return rows.join(done.select(key).distinct(), key, "left_anti")
    last = done.agg(F.max_by(key, done_pos).alias(key))
    at = rows.join(F.broadcast(last), key).agg(F.min(pos).alias("_last"))
    return rows.join(F.broadcast(at), F.col(pos) > F.coalesce("_last", F.lit(-1))).drop("_last")


def chunk(pos: Column, n: int) -> Column:
    return F.floor(pos / n).cast("long")


def draw(seed: int, *of: Column) -> Column:
    """A value in 0..2^52 that depends on the seed and the columns only; the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in of))), 1, 13), 16, 10).cast("long")


def share(seed: int, *of: Column) -> Column:
    """As a number in [0, 1)."""
    return draw(seed, *of) / float(1 << 52)


def shuffled(rows: DataFrame, seed: int, key: str) -> DataFrame:
    """Rows in a seeded order."""
    return rows.orderBy(draw(seed, F.col(key)), key)


def sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """The first n rows of a seeded shuffle; a top-n in each partition, then of those."""
    return shuffled(rows, seed, key).limit(n)


def split(rows: DataFrame, test: float | int, seed: int, key: str) -> DataFrame:
    """rows with is_test: exactly the share (rounded up) or count asked for, by seeded rank."""
    total = rows.count()
    n = -int(-total * test // 1) if isinstance(test, float) else min(test, total)
    ranked = with_pos(rows.withColumn("_draw", draw(seed, F.col(key))), "_draw", key, name="_rank")
    return ranked.withColumn("is_test", F.col("_rank") < n).drop("_draw", "_rank")


def choose(options: Column, seed: int, *of: Column) -> Column:
    """One of an array's elements, uniformly."""
    return F.element_at(options, (F.pmod(draw(seed, *of), F.size(options)) + 1).cast("int"))


def choose_some(options: Column, k: Column | int, seed: int, *of: Column) -> Column:
    """k different elements of an array in random order."""
    k = F.lit(k) if isinstance(k, int) else k
    keyed = F.transform(options, lambda x, i: F.struct(draw(seed, *of, i).alias("d"), i.alias("i"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(keyed), F.lit(1), k), lambda s: s["x"])
