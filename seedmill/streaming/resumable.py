"""Generation and execution as resumable micro-batches.

A stream over new JSON files takes the place of the append log: the checkpoint remembers what is done, ``availableNow`` works off
what is there and ends, and each micro-batch replaces its own output partition, so a repeated batch doesn't
write twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.commits import Table
from ..sources.files import write_chunk


def guard(spark: SparkSession, out: str, fingerprint: str, start: int, ignore_fingerprint: bool = False) -> None:
    """Writes a run's fingerprint and start index beside its output; a run that resumes with others is an error."""
    path = f"{out}/_manifest"  # readers pass over names that begin with an underscore
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    held = spark.read.schema("fingerprint string, start long").json(path).first() if there else None
    if held is None:  # also after a run that was killed before its row was written
        spark.createDataFrame([(fingerprint, start)], "fingerprint string, start long").coalesce(1).write.mode("overwrite").json(path)
        return
    if held.fingerprint != fingerprint and not ignore_fingerprint:
        raise ValueError(f"the output was made with fingerprint {held.fingerprint}, not {fingerprint}")
    if held.start != start:
        raise ValueError(f"the output begins at {held.start}, not {start}")


def run(spark: SparkSession, source: str, schema: str, stage: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 32, pause: float = 0.0, table: Table | None = None) -> StreamingQuery:
    """Apply stage to every micro-batch of new files and write its rows; before each batch but the first, pause that many seconds.

    With a table, batches become its chunks by commits: readers see whole batches only, and a repeated one takes its own place.
    """

    def work(df: DataFrame, k: int) -> None:
        if k and pause:
            time.sleep(pause)
        if table:
            table.write(stage(df), chunk=k)
        else:
            write_chunk(stage(df), out, k)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event type in tumbling windows, for batch tables and streams (an extension)."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        df = df.withWatermark("ts", late)
    return df.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
