"""Operator 12: quality by histogram gradient-boosted trees over document statistics.

A document becomes a row of ``FEATURES`` (lengths, shares of character classes, repetition of words and lines). Trees of depth
``DEPTH`` are grown level by level: statistics are cut into at most ``BINS`` bins at quantiles, and a level's splits come from
sums of gradients and hessians per node, statistic and bin. The model is three flat arrays (statistic and threshold of
each inner node, value of each leaf, heap order), walked for all rows of a batch at once, one level of all trees at a time.

Scale: scoring is one scan and shuffles nothing; the model is a few tens of KB. The fit takes a bounded sample of labelled rows:
about ``SAMPLE_DOCS`` documents, chosen by a hash of the id. Their statistics are computed where the texts are read; only these
numbers (under 200 bytes a document) are shuffled and meet in one task.

Defined results: null and empty texts are a document whose statistics are all zero; without labelled rows of both kinds the
score is the share of good ones (1.0 if there are none); a doc_id labelled twice counts as bad if any label says so;
null labels teach nothing; of several rows of one doc_id one teaches; repeated rows are scored one by one; empty tables give no
rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, id_text, map_rows, text_bytes

SAMPLE_DOCS = 40_000
TREES, DEPTH, BINS, RATE, L2, LEAST_HESSIAN = 60, 4, 64, 0.2, 1.0, 1.0
PASS_AT = 0.7

FEATURES = (
    *("bytes", "words", "lines", "word_bytes", "line_words"),
    *("upper", "lower", "digit", "space", "stop", "comma", "other_mark", "control", "beyond_ascii"),
    *("distinct_words", "top_word", "top_ten_words", "same_as_before", "ends_in_mark"),
    *("distinct_lines", "repeated_line_bytes", "short_lines"),
)


def _classes() -> np.ndarray:
    """For each byte value, which of the nine character classes it is in."""
    out = np.zeros((256, 9))
    for b in range(256):
        c = chr(b)
        if b >= 128:
            k = 8
        elif c.isalpha():
            k = 0 if c.isupper() else 1
        elif c.isdigit():
            k = 2
        elif c.isspace():
            k = 3
        elif c in ".!?":
            k = 4
        elif c in ",;:":
            k = 5
        else:
            k = 6 if c.isprintable() else 7
        out[b, k] = 1
    return out


CLASSES = _classes()
_MARKS = tuple(bytes([b]) for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:?'\")")


def statistics(raw: bytes) -> list[float]:
    """The FEATURES of one text."""
    if not raw:
        return [0.0] * len(FEATURES)
    classes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ CLASSES
    ws, lines = raw.split(), raw.split(b"\n")
    n, n_lines = max(1, len(ws)), len(lines)
    often = Counter(ws)
    most = [c for _, c in often.most_common(10)] or [0]
    once = Counter(lines)
    return [
        *(np.log1p(len(raw)), np.log1p(len(ws)), np.log1p(n_lines), sum(map(len, ws)) / n, len(ws) / n_lines),
        *(classes / len(raw)).tolist(),
        *(len(often) / n, most[0] / n, sum(most) / n, sum(map(eq, ws, ws[1:])) / n, sum(w.endswith(_MARKS) for w in ws) / n),
        *(len(once) / n_lines, sum(len(x) * (c - 1) for x, c in once.items()) / len(raw), sum(len(x) < 30 for x in lines) / n_lines),
    ]


class Trees:
    """Boosted trees as flat arrays in heap order: node k has children 2k + 1 (at most the threshold) and 2k + 2."""

    def __init__(self, bias: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.bias, self.feature, self.threshold, self.leaf = bias, feature, threshold, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows x statistics."""
        n_trees, n_inner = self.feature.shape
        tree, row = np.arange(n_trees)[None, :], np.arange(len(x))[:, None]
        at = np.zeros((len(x), n_trees), np.int64)
        for _ in range((n_inner + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return self.bias + self.leaf[tree, at - n_inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _constant(share: float) -> Trees:
    odds = -35.0 if share <= 0 else 35.0 if share >= 1 else float(np.log(share / (1 - share)))
    return Trees(odds, np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 1)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Fit boosted trees to rows x statistics and their labels."""
    if not len(y) or y.min() == y.max():
        return _constant(float(y.mean()) if len(y) else 1.0)
    n, n_features = x.shape
    # Edges are values of the sample; a bin holds what is over the edge before it and at most its own.
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(n_features)]
    width = max(map(len, edges)) + 1
    place = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1) + np.arange(n_features) * width
    n_inner = (1 << depth) - 1
    feature, threshold, leaf = np.zeros((trees, n_inner), np.int64), np.full((trees, n_inner), np.inf), np.zeros((trees, n_inner + 1))
    bias = float(np.log(y.mean() / (1 - y.mean())))
    odds = np.full(n, bias)
    value = lambda g, h: g * g / (h + L2)
    for t in range(trees):
        p = _sigmoid(odds)
        grad, hess = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for d in range(depth):
            first, here = (1 << d) - 1, 1 << d
            cell = ((at - first) * (n_features * width))[:, None] + place
            sums = [np.bincount(cell.ravel(), weights=np.repeat(v, n_features), minlength=here * n_features * width).reshape(here, n_features, width) for v in (grad, hess)]
            g, h = (s.cumsum(axis=2) for s in sums)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = value(g, h) + value(all_g - g, all_h - h) - value(all_g, all_h)
            gain[(h < LEAST_HESSIAN) | (all_h - h < LEAST_HESSIAN)] = 0
            best = gain.reshape(here, -1).argmax(axis=1)
            for k in range(here):
                f, b = divmod(int(best[k]), width)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        g, h = (np.bincount(at - n_inner, weights=v, minlength=n_inner + 1) for v in (grad, hess))
        leaf[t] = -rate * g / (h + L2)
        odds += leaf[t, at - n_inner]
    return Trees(bias, feature, threshold, leaf)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    x, y = [], []
    for batch in batches:
        x += column(batch, "x").to_pylist()
        y += column(batch, "quality").to_pylist()
    model = grow(np.array(x, float).reshape(-1, len(FEATURES)), np.array(y, float))
    parts = [np.array(model.feature.shape, "<i8"), model.feature.astype("<i8"), model.threshold.astype("<f8"), model.leaf.astype("<f8")]
    yield pa.RecordBatch.from_arrays([pa.array([model.bias]), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], ["bias", "shape", "feature", "threshold", "leaf"])


def features(rows: DataFrame) -> DataFrame:
    """doc_id and x (FEATURES as floats) of rows (doc_id, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [statistics(t) for t in text_bytes(batch)]
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return rows.mapInArrow(map_rows(run), "doc_id long, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Trees:
    """Trees for the chance of label 1; train is a condition on labels' rows."""
    known = labels.filter(train).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("quality")).filter("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    if not n:
        return _constant(1.0)
    some = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_000)) < min(1.0, sample_docs / n) * 1_000_000)
    texts = id_text(docs, id_col, text_col).join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi")
    # An id with many rows gives the least of its rows' statistics; partial aggregates keep one for each task.
    sample = features(texts).groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(some), "doc_id")
    row = sample.repartition(1).sortWithinPartitions("doc_id").select("x", "quality").mapInArrow(_train, "bias double, shape binary, feature binary, threshold binary, leaf binary").first()
    if row is None:
        return _constant(1.0)
    trees, inner = np.frombuffer(row.shape, "<i8").tolist()
    shaped = lambda b, kind, width: np.frombuffer(b, kind).reshape(trees, width)
    return Trees(row.bias, shaped(row.feature, "<i8", inner), shaped(row.threshold, "<f8", inner), shaped(row.leaf, "<f8", inner + 1))


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", pass_at: float = PASS_AT) -> DataFrame:
    """Per row: doc_id, score (0 to 1), predicted (1 if score >= pass_at)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = held.value.score(np.array([statistics(t) for t in text_bytes(batch)]))
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(p), pa.array((p >= pass_at).astype(np.int32))], ["doc_id", "score", "predicted"])

    return id_text(docs, id_col, text_col).mapInArrow(map_rows(run), "doc_id long, score double, predicted int")
