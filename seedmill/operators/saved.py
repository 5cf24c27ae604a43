"""Tables written in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Folders that were not deleted yet, with their sessions.
_OPEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset and the master is local (tests), a temporary folder takes its place."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="seedmill-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], True)
    return _LOCAL["dir"]


def scratch_path(spark: SparkSession) -> str:
    """A new folder's name in the shared folder; it is deleted as saved tables are."""
    path = f"{shared_dir(spark)}/seedmill/saved-{uuid.uuid4().hex}"
    _OPEN[path] = spark
    return path


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and written as Parquet; its lineage ends there, and later reads take only the columns they need."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by a key over as many tasks as a shuffle has, for work that costs far more than its bytes tell.

    After a shuffle without a number, Spark joins small partitions by their bytes, and few tasks would do all of that work. The
    key is hashed because Spark drops a shuffle by what rows are dealt out by already.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), F.xxhash64(key))


def _delete(path: str) -> None:
    spark = _OPEN.pop(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def released() -> Iterator[None]:
    """Deletes what was saved inside, also on failure; for steps whose result has been written."""
    before = set(_OPEN)
    try:
        yield
    finally:
        for path in set(_OPEN) - before:
            _delete(path)


@atexit.register
def _release_all() -> None:
    """What results still read goes when the driver ends, if Spark is still there."""
    for path in list(_OPEN):
        with suppress(Exception):
            if SparkSession.getActiveSession() is not None:
                _delete(path)
