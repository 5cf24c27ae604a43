"""One id, or none, on a third of the rows each: no partition gets them all, and results stay what they were. Many blocks, many languages."""

import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seedmill.llm import decontamination, langid, lines, packing, suffixes, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
HOT_ID = "case when id % 3 = 0 then null when id % 3 = 1 then 7 else id end"


def largest_share(counts):
    return max(counts) / sum(counts)


@pytest.mark.parametrize("text", ["concat('word', id)", "'the same text'"])
def test_token_files_of_hot_ids(spark, tmp_path, text):
    n = 100_000
    docs = spark.range(n).selectExpr(f"{HOT_ID} doc_id", f"{text} text")
    path = str(tmp_path / "tokens")
    # Small partitions are left as they are, as large ones would be.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_tokens(docs, path, PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = spark.read.parquet(path)
    assert largest_share([r["sum(n_tokens)"] for r in shards.groupBy("part").sum("n_tokens").collect()]) < 0.4
    back = token_files.read_tokens(spark, path)
    got = back.agg(F.count("*"), F.sum("n_tokens"), F.max(F.col("start") + F.col("n_tokens")), F.count("doc_id")).first()
    assert (got[0], got[3]) == (n, n - (n + 2) // 3) and got[1] == got[2]
    # Ascending ids, those without first.
    ids = [(r.doc_id is not None, r.doc_id) for r in back.select("doc_id", "start").sort("start").collect()]
    assert ids == sorted(ids, key=lambda x: (x[0], x[1] or 0))


def test_packing_of_hot_ids(spark):
    n, rows = 60_000, 10_000
    pieces = spark.range(n).selectExpr(f"{HOT_ID} doc_id", "cast(0 as int) piece", "cast(1 + id * 7919 % 2048 as bigint) length")
    out = packing.pack(pieces, rows=rows).cache()
    first = out.filter("sequence_id < (1L << 56)").groupBy(F.shiftright("sequence_id", 32)).count().collect()
    assert len(first) >= 6 and max(r["count"] for r in first) <= rows
    total = out.agg(F.count("*"), F.countDistinct("sequence_id"), F.sum("length")).first()
    assert total[0] == n and total[1] <= 1.01 * -(-total[2] // 2048)
    out.unpersist()


def kept(docs):
    """Line dedup in plain Python: rows of (doc_id, text) -> sorted hashes of what is left."""
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for d, t in docs:
        if d is not None:
            for x in t.split("\n"):
                if len(key(x)) >= 40:
                    holders.setdefault(key(x), set()).add(d)
    out = []
    for d, t in docs:
        left = [x for x in t.split("\n") if d is None or len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == d]
        out.append((str(d), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out)


def test_lines_of_hot_ids(spark):
    """Lines on far more rows than a task holds: of four documents (kept), of six (dropped but for one), and of one that repeats a row."""
    few, many, own = ("%s line that is well over forty characters long" % x for x in ("few", "many", "own"))
    docs = [(d, "\n".join([f"row {k}", few] * 3)) for d in (1, 2, 3, 4) for k in range(700)]
    docs += [(d, "\n".join([f"row {k}", many, many])) for d in (1, 2, 3, 4, 5, 6) for k in range(500)]
    docs += [(9, "\n".join([own] * 3))] * 1500 + [(None, many), (8, ""), (6, many), (5, many + "\n" + few)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = kept(docs)
    got = lines.apply(df, lines.bitmaps(df))
    assert sorted((str(r.doc_id), r.kept_sha256) for r in got.select("doc_id", "kept_sha256").collect()) == want


def test_lines_hold_few_rows(monkeypatch):
    """One hash on 200,000 rows of one document: what waits stays under HELD, and every row is passed on."""
    waiting = []

    class Watched(lines._Run):
        def add(self, *a):
            super().add(*a)
            waiting.append(len(self.held))

    monkeypatch.setattr(lines, "_Run", Watched)
    n = 200_000
    rows = {"hi": np.r_[0, np.ones(n, np.int64)], "lo": np.r_[0, np.ones(n, np.int64)], "doc_id": np.full(n + 1, 7), "nk": np.arange(n + 1), "pos": np.zeros(n + 1, np.int32)}
    table = pa.table({k: np.concatenate((v[:1], v)) for k, v in rows.items()})
    out = list(lines.stream()(iter(table.to_batches(max_chunksize=10_000))))
    assert max(waiting) <= lines.HELD and max(b.num_rows for b in out) < 40_000
    edge = [r for b in out for r in b.to_pylist() if r["hi"] == 1]
    assert len(edge) == n and {r["kind"] for r in edge} == {lines.EDGE} and sum(r["n"] for r in edge) == 1


def test_line_ranges_split_one_document(spark):
    keyed = spark.range(100_000).selectExpr("1L hi", "1L lo", "7L doc_id", "id nk", "cast(0 as int) pos")
    order = (F.col("hi"), F.col("lo"), F.col("doc_id").desc(), F.col("nk"), F.col("pos"))
    assert largest_share([r["count"] for r in keyed.repartitionByRange(8, *order).groupBy(F.spark_partition_id()).count().collect()]) < 0.3


def test_contexts_of_equal_rows_are_cut_once():
    raw = bytes(random.Random(1).randrange(97, 120) for _ in range(900))
    w = [{"g": 1, "m": 2, "n": 3000, "pos": p} for p in (0, 450)]
    batch = pa.RecordBatch.from_pylist([{"doc_id": 7, "nk": 2, "text": raw.decode(), "wanted": w}] * 500 + [{"doc_id": 7, "nk": 4, "text": raw.decode(), "wanted": w[:1]}])
    again = pa.RecordBatch.from_pylist([{"doc_id": 7, "nk": 4, "text": raw.decode(), "wanted": w[:1]}] * 3)
    cut = list(suffixes._cut_contexts(400)(iter([batch, again])))
    assert sum(b.num_rows for b in cut) == 3


def test_removals_of_hot_ids(spark):
    """Equal rows under one id and without id lose everything; others keep their text."""
    rng = random.Random(2)
    text = lambda: "".join(rng.choice("abcdefgh ijkl") for _ in range(900))
    hot, alone = text(), [text() for _ in range(60)]
    rows = [(7, hot)] * 700 + [(None, hot)] * 700 + list(enumerate(alone)) + [(7, t) for t in alone[:3]]
    got = suffixes.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    left = [(r.doc_id, len(r.kept)) for r in got.select("doc_id", "kept").collect()]
    assert len(left) == len(rows) and sum(n == 0 for _, n in left) == 1406 and sum(n == 900 for _, n in left) == 57


def words_of(k, n=30):
    rng = random.Random(k)
    return " ".join(f"w{rng.randrange(400)}" for _ in range(n))


def test_many_blocks_share_one_worker(spark):
    """A benchmark in some sixty blocks: one pass over the rows, and the rows of one block."""
    items = spark.createDataFrame([(k, words_of(k, 14)) for k in range(500)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join([words_of(1000 + k), words_of(k % 700, 14) if k % 2 else "", words_of(k * 3 % 500, 14)[: 40 * (k % 3)]])) for k in range(400)], "doc_id long, text string").repartition(2)
    one = decontamination.find(docs, items)
    many = decontamination.find(docs, items, block_bytes=1000)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("MapInArrow", plan)) == 1
    rows = lambda df: sorted((r.doc_id, r.n_words, tuple(r.items), tuple(map(tuple, r.spans))) for r in df.drop("text").collect())
    assert rows(many) == rows(one) and sum(bool(r[2]) for r in rows(one)) > 100


def test_blocks_leave_the_worker_one_by_one():
    class Held:
        loads, alive = 0, 0

        def __init__(self):
            self._path = "file"

        @property
        def value(self):
            if "_value" not in self.__dict__:
                Held.loads += 1
                self._value = object()
            return self._value

    held = [Held() for _ in range(5)]
    for _ in range(2):
        for _ in decontamination._in_turn(held):
            assert sum("_value" in h.__dict__ for h in held) == 1
    assert Held.loads == 10
    list(decontamination._in_turn(held[:1])), list(decontamination._in_turn(held[:1]))
    assert Held.loads == 11


def test_many_languages(spark):
    """2,000 labels: the model learns as many as it is told to, those with the most rows, in bounded time."""
    rows = [(k, f"l{k % 1990:04d}" if k % 4 else f"common{k % 10}", words_of(k, 12)) for k in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    began = time.time()
    model = langid.fit(docs, F.lit(True))
    assert time.time() - began < 60 and len(model.names) == langid.MOST_LANGUAGES and all(n.startswith("common") for n in model.names[:5])
    assert len(langid.fit(docs, F.lit(True), most=3).names) == 3
    assert langid.fit(docs.limit(0), F.lit(True)).names == ()
    assert {r.lang_pred for r in langid.classify(docs.limit(50), langid.fit(docs, F.lit(True), most=2)).collect()} <= {n for n in model.names[:2]}
