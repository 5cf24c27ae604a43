"""What the operators share: the folder all executors see, written tables, and Arrow helpers.

Rows that operators exchange are narrow: each operator first selects the id and the text column it was told
of, so extra columns, whatever their names, never clash with columns that an operator adds.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Folders of tables that were not deleted yet.
_OPEN: dict[str, Scratch] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset and the master is local (tests), a
    temporary folder takes its place; on a cluster without the setting this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="seedmill-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], True)
    return _LOCAL["dir"]


class Scratch:
    """Tables written for one run of an operator, below the shared folder.

    Writing cuts lineage, so a lost executor costs a re-read and not a re-run. Parquet output goes through
    Spark's commit protocol: a retried task never leaves half a file behind. Operators delete what their result
    does not read; ``released`` deletes the rest once a result has been written, and so does the driver's end.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/seedmill/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        _OPEN[self.root] = self

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back."""
        self.names.add(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            self._delete(self.path(name))
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Delete all tables but these, which the result reads."""
        self.drop(*(self.names - set(names)))

    def close(self) -> None:
        """Delete all of it."""
        self._delete(self.root)
        _OPEN.pop(self.root, None)

    def _delete(self, path: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def released() -> Iterator[None]:
    """Deletes the tables of all operators that ran inside, also if one fails. For steps whose result has been written."""
    before = set(_OPEN)
    try:
        yield
    finally:
        for root in set(_OPEN) - before:
            _OPEN[root].close()


@atexit.register
def _release_all() -> None:
    """What results still read goes when the driver ends, if Spark is still there."""
    for scratch in list(_OPEN.values()):
        with suppress(Exception):
            if SparkSession.getActiveSession() is not None:
                scratch.close()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that operators read, under fixed names; the scan reads no others."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A column's texts as UTF-8; null gives b''."""
    return [b"" if x is None else x for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def map_rows(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: fn over each batch that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return run


def map_shards(fn: Callable[[pa.RecordBatch], pa.RecordBatch], size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: fn over the batches of a task, joined until they hold size bytes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.nbytes
            if n >= size:
                yield fn(pa.concat_batches(held))
                held, n = [], 0
        if held:
            yield fn(pa.concat_batches(held))

    return run
