"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, benchmark decontamination, best-fit packing.

Each stage works on all that the one before it kept, and is written as Parquet and read again. All but the last return the
columns of documents. The dedup stages decide by row, whatever its doc_id: of copies the row with the least doc_id stays (rows
without one come last), of several the one first numbered. Copies are never broadcast: they grow with the documents.

Defined results: null texts and texts without a letter are rejected by the first stage, so no later one meets them there; each
stage takes them by its operator's rules all the same. Repeated rows are copies of each other; an empty table gives no rows;
extra columns, whatever their names, pass all stages but the last, which returns the pieces' own columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedmill.llm import decontamination, exact, langid, packing, simhash
from seedmill.llm.common import Scratch, released
from seedmill.llm.queries import TOKENIZER, remainder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression can tell."""
    keep = "_keep"
    while keep in docs.columns:
        keep = "_" + keep
    model = langid.fit(docs, remainder(4) != 2)
    return langid.keep_column(docs, model, keep).filter(keep).drop(keep)


def numbered(spark: SparkSession, docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """docs, written with a number for each row, and the number's column."""
    key = "_row"
    while key in docs.columns:
        key = "_" + key
    return Scratch(spark, name).table(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def without_copies(rows: DataFrame, key: str, members: DataFrame, columns: list[str]) -> DataFrame:
    """The rows, but of each group of members (row, group) only that with the least doc_id, then the least number."""
    ids = rows.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    first = members.join(ids.hint("merge"), "row").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    # By row on both sides: a group may hold a third of all rows.
    copies = members.join(first.select(F.col("first.row").alias("row")).hint("merge"), "row", "left_anti").select(F.col("row").alias(key))
    return rows.join(copies.hint("merge"), key, "left_anti").select(*columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (white space aside) the one with the least doc_id."""
    rows, key = numbered(spark, docs, "exact_dedup")
    members = exact.groups(rows, key).filter("group_size > 1").select(F.col("doc_id").alias("row"), F.col("keep_id").alias("group"))
    return without_copies(rows, key, Scratch(spark, "exact_dedup").table(members, "members"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the row with the least doc_id."""
    rows, key = numbered(spark, docs, "near_dedup")
    members = simhash.groups(rows, id_col=key).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    return without_copies(rows, key, Scratch(spark, "near_dedup").table(members, "members"), docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and places."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: SQL can't express language ID by compression, SimHash or the tokenizer; a test holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        # What a stage's operator wrote goes once the stage's rows are written, and those once the next stage's are.
        with released():
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        scratch.keep(name)
    return docs
