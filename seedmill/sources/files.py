"""JSONL, Parquet and text sources and sinks with explicit schemas; paths go to Spark's readers only."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.position import with_pos


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """JSON lines under a schema, in one scan. Malformed lines are errors; so are blank ones if strict, else they are skipped."""
    raw = spark.read.text(paths)
    blank = F.trim("value") == ""
    # Checked by a filter, which also runs where no column is read.
    kept = F.when(blank, F.raise_error(F.lit("a blank line in strict mode")).cast("boolean")).otherwise(True) if strict else ~blank
    return raw.filter(kept).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("s")).select("s.*")


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines that keep keys with null values."""
    rows.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_chunk(rows: DataFrame, path: str, chunk: int) -> None:
    """One chunk of a resumable run as a partition of its own: a repeated chunk replaces itself."""
    write_jsonl(rows, f"{path}/chunk={chunk}")


def write_after_cached(cached: DataFrame, new: DataFrame, path: str) -> None:
    """A sink that begins anew with the cached rows and then the new ones.

    Both are written beside the target before it is touched, so they may be read from the target itself. A reader between the two
    renames finds nothing; ``commits.Table`` has no such moment.
    """
    spark, beside = cached.sparkSession, f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    write_jsonl(cached, beside)
    write_jsonl(new, beside, append=True)
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (beside, path))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"{beside} can't be renamed to {path}")


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def table_reader(spark: SparkSession, pattern: str, schema: str) -> Callable[[str], DataFrame]:
    """A reader of named Parquet tables: a name takes the place of ``{name}`` in the pattern; a name without a table is an empty one."""

    def read(name: str) -> DataFrame:
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern.format(name=name))
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        return spark.read.schema(schema).parquet(str(path)) if there else spark.createDataFrame([], schema)

    return read


def write_table(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_whole_texts(spark: SparkSession, glob: str) -> DataFrame:
    """Every file that the pattern names as one row (path, text)."""
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_jsonl_with_pos(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON lines with pos, in the order of files and of lines within them."""
    raw = spark.read.schema(schema).json(paths)
    located = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    return with_pos(located, "_file", "_block", "_line").drop("_file", "_block", "_line")
