"""Operator 9: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words, pairs of neighbours and pairs one apart, hashed into 2^20 weights. Training
is online, with a learning rate for each weight and L1 shrinkage, so most weights stay exactly zero; the others
are broadcast (at most 2^20 pairs of 12 bytes) and scoring is one scan with array look-ups.

Scale: scoring shuffles nothing. The fit takes a bounded sample of labelled rows: about ``SAMPLE_DOCS``, chosen by a hash of
the id, joined to the documents as a broadcast of that bound, one text for each, in one task. Only where these exceed ``SAMPLE_BYTES``
the longest are cut, all at the same length, so that every sampled document takes part.

Defined results: null and empty texts get the bias's score; without labelled rows of both kinds the score is the share
of toxic ones (0.0 if there are none); a doc_id labelled twice counts as toxic if any label says so; null labels teach nothing;
repeated rows are scored one by one; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, id_text, map_rows, text_bytes
from .words import words

BITS = 20
SAMPLE_DOCS, SAMPLE_BYTES = 16_000, 96 << 20
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 3.0, 1.0, 3


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of all texts, the text of each, and the count of words of each text."""
    lists = [words(t) for t in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    h = np.fromiter(map(zlib.crc32, chain.from_iterable(lists)), np.uint64, int(n.sum()))
    of = np.repeat(np.arange(len(lists)), n)
    found, texts_of = [h], [of]
    for step, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > step:
            same = of[step:] == of[:-step]
            found.append(((h[:-step] * np.uint64(salt)) ^ (h[step:] * np.uint64(0xD6E8FEB86659FD93)))[same])
            texts_of.append(of[step:][same])
    mixed = np.concatenate(found) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(texts_of), n


class Ftrl:
    """FTRL-proximal with a rate for each coordinate (McMahan et al., 2013)."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.bias_z = self.bias_n = 0.0

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    @property
    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def step(self, at: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.bias
        g = _sigmoid(float(w.sum()) + b) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.bias_z += g - ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha * b
        self.bias_n += g * g


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features, labels = [], []
    for batch in batches:
        for text, label in zip(text_bytes(batch), column(batch, "toxic").to_pylist(), strict=True):
            features.append(np.unique(grams([text])[0]).astype(np.int32))
            labels.append(label)
    model = Ftrl(1 << BITS)
    if len(set(labels)) == 2:
        order = np.random.default_rng(5)
        for _ in range(EPOCHS):
            for k in order.permutation(len(labels)).tolist():
                model.step(features[k], labels[k])
        bias = float(model.bias)
    else:
        bias = 35.0 if labels and labels[0] else -35.0
    w = model.weights()
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([at.astype("<i4").tobytes()]), pa.array([w[at].astype("<f8").tobytes()])], ["bias", "at", "w"])


def fair_share(sizes: list[int], budget: int) -> int:
    """The largest bound on each size under which their sum fits the budget; no size is bounded if all fit."""
    left = budget
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) > left:
            return left // (len(sizes) - k)
        left -= n
    return max(sizes, default=0)


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, and the places and values of the weights that are not zero; train is a condition on labels' rows."""
    known = labels.filter(train).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if not n:
        return -35.0, np.empty(0, np.int64), np.empty(0)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000))
    some = known.filter(draw < min(1.0, sample_docs / n) * 1_000_000)
    sample = id_text(docs, id_col, text_col).join(F.broadcast(some), "doc_id").withColumns({"draw": draw, "pick": F.xxhash64("text", F.lit(17))})
    # An id with many rows gives one of its texts; two numbers for each id go to the driver.
    picked = sample.groupBy("doc_id").agg(F.min(F.struct("pick", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))).alias("p")).select("doc_id", "p.*").collect()
    if not picked:
        return -35.0, np.empty(0, np.int64), np.empty(0)
    bound = fair_share([r.size for r in picked], SAMPLE_BYTES)
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, r.pick) for r in picked], "doc_id long, pick long")
    # A character may be cut at the bound; words take bytes.
    sample = sample.join(F.broadcast(chosen), ["doc_id", "pick"]).select("doc_id", "toxic", "draw", F.substring(F.col("text").cast("binary"), F.lit(1), F.lit(bound)).alias("text"))
    sample = sample.groupBy("doc_id", "toxic", "draw").agg(F.min("text").alias("text"))
    row = sample.repartition(1).sortWithinPartitions("draw", "doc_id").mapInArrow(_train, "bias double, at binary, w binary").first()
    return row.bias, np.frombuffer(row.at, "<i4").astype(np.int64), np.frombuffer(row.w, "<f8")


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1), predicted (1 if score >= 0.5)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bias, at, w = held.value
        table = np.zeros(1 << BITS)
        table[at] = w
        texts = text_bytes(batch)
        total = np.full(len(texts), bias)
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= 4 << 20):
                size += len(texts[b])
                b += 1
            feature, of, _ = grams(texts[a:b])
            live = table[feature] != 0
            once = np.unique((of[live] << BITS) | feature[live])
            total[a:b] += np.bincount(once >> BITS, weights=table[once & ((1 << BITS) - 1)], minlength=b - a)
            a = b
        p = _sigmoid(total)
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return id_text(docs, id_col, text_col).mapInArrow(map_rows(run), "doc_id long, score double, predicted int")
