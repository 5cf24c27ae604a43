"""The registered queries at the smallest scale: SQL twins, and the pipeline against its stages' plain meaning."""

import glob
import hashlib
import math
import os
import re
import zlib
from array import array
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from seedmill.llm import common, langid, packing, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = queries.queries()[name](spark, SF).toPandas(), db.sql(queries.oracle_sql()[name]).df()
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    q = queries.queries()
    # The first stage's decisions by its operator's query, the others by theirs on what is left.
    rejected = {r.doc_id for r in q["op6_language_id"](spark, SF).filter("rejected").collect()}
    left = ids - rejected
    groups = {}
    for r in q["op7_exact_dedup"](spark, SF).collect():
        if r.doc_id in left:
            groups.setdefault(r.text_sha256, []).append(r.doc_id)
    left = {min(g) for g in groups.values()}
    fps = {r.doc_id: int(r.fingerprint, 16) for r in q["op5_simhash_near_dedup"](spark, SF).collect() if r.doc_id in left}
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    left = {d for d in fps if find(d) == d}
    dirty = {r.doc_id for r in q["op4_decontamination"](spark, SF).filter("contaminated").collect()}
    left -= dirty
    pieces = {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in q["op3_best_fit_packing"](spark, SF).collect() if r.doc_id in left}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == pieces and len(got) == len(pieces)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS n_words", "'x' AS _keep", "2 AS kept")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_dedup_stages_decide_by_row(spark):
    """Copies without doc_id, whole rows repeated under one id, and one id with a copy and a text of its own."""
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    text = lambda k: " ".join(words[k:] + words[:k] + [f"w{k}{j}" for j in range(30)])
    rows = [(1, text(1)), (None, text(1)), (None, text(2)), (None, text(2)), (3, text(3)), (3, text(3)), (4, text(1)), (4, text(4)), (9, text(5)), (8, text(5)), (None, text(6))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    want = sorted([(1, text(1)), (None, text(2)), (3, text(3)), (4, text(4)), (8, text(5)), (None, text(6))], key=str)
    for stage in (corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup):
        got = stage(spark, docs, SF)
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want and got.columns == docs.columns


# The registered queries against plain versions, over all rows of the smallest tables.


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))


def result(spark, name):
    return queries.queries()[name](spark, SF).collect()


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_op1(spark, documents, tokenizer):
    want, at = [], 0
    for k in sorted(documents):
        ids = [*tokenizer.encode(documents[k], add_special_tokens=False).ids, 1]
        want.append((k, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(tuple(r) for r in result(spark, "op1_token_files")) == want


def test_op2(spark, documents):
    size, raw = 400, {k: t.encode() for k, t in documents.items()}
    count = Counter(hashlib.blake2b(t[i : i + size], digest_size=16).digest() for t in raw.values() for i in range(len(t) - size + 1))
    got = {r.doc_id: tuple(r)[1:] for r in result(spark, "op2_suffix_dedup")}
    assert set(got) == set(raw)
    for k, t in raw.items():
        mark = np.zeros(len(t) + 1, int)
        for i in range(len(t) - size + 1):
            if count[hashlib.blake2b(t[i : i + size], digest_size=16).digest()] > 1:
                mark[i] += 1
                mark[i + size] -= 1
        gone = np.cumsum(mark)[: len(t)] > 0
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert got[k] == (len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())


def test_op3(spark, documents, tokenizer):
    want = set()
    for k, t in documents.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        want |= {(k, p, a, len(x := ids[a : a + 2048]), crc(x)) for p, a in enumerate(range(0, len(ids), 2048))}
    rows = result(spark, "op3_best_fit_packing")
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [a for a, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(bins) <= packing.lower_bound(np.array([r.length for r in rows]), 2048) * 1.01 + 1


def test_op5(spark, documents):
    fps = {}
    for k, t in documents.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3) if w else 0)]
        fps[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {k: k for k in fps}
    for _ in range(len(fps)):
        was = dict(root)
        for a in fps:
            root[a] = min(root[b] for b in fps if (fps[a] ^ fps[b]).bit_count() <= 4)
        if was == root:
            break
    assert {tuple(r) for r in result(spark, "op5_simhash_near_dedup")} == {(k, f"{fps[k]:016x}", root[k]) for k in fps}


def test_op6(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, queries.remainder(4) != 2)
    counts = Counter(r.lang for r in docs.select("doc_id", "text", "lang").collect() if remainder(r.doc_id, 4) != 2 and r.lang is not None and r.text is not None)
    assert model.names == tuple(sorted(counts, key=lambda x: (-counts[x], x)))
    got = {r.doc_id: r for r in result(spark, "op6_language_id")}
    assert set(got) == set(documents)
    for k, t in documents.items():
        assert got[k].held_out == (remainder(k, 4) == 2)
        if not any(c.isalpha() for c in t):
            assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
            continue
        low = t.translate({c: c + 32 for c in range(65, 91)}).encode()
        low = (low + b"\n") * 3 if len(low) < langid.SHORT else low
        sizes = []
        for content in model.contents:
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes.append(sum(len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(low[a : a + langid.CHUNK])) for a in range(0, len(low), langid.CHUNK)))
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        assert got[k].lang_pred == model.names[best] and got[k].score == pytest.approx(1 / sum(2.0 ** (sizes[best] - s) for s in sizes))
    right = [got[r.doc_id].lang_pred == r.lang for r in docs.filter("lang is not null").collect() if remainder(r.doc_id, 4) == 2 and any(c.isalpha() for c in r.text or "")]
    assert sum(right) / len(right) > 0.9


def test_op9(spark, documents):
    """FTRL-proximal with dictionaries, one weight at a time."""
    mask = (1 << 64) - 1
    a, b, c = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93

    def features(text):
        h = [zlib.crc32(w.encode()) for w in plain_words(text)]
        found = set(h) | {(x * s & mask) ^ (y * c & mask) for n, s in ((1, a), (2, b)) for x, y in zip(h, h[n:])}
        return sorted({(x * a & mask) >> (64 - toxicity.BITS) for x in found})

    labels = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r.doc_id is not None and r.toxic is not None and remainder(r.doc_id, 5):
            labels[r.doc_id] = max(r.toxic, labels.get(r.doc_id, 0))
    draw = {r.doc_id: r.d for r in spark.createDataFrame([(k,) for k in labels], "doc_id long").selectExpr("doc_id", "pmod(xxhash64(doc_id, 11), 1000000) AS d").collect()}
    order = sorted((k for k in labels if k in documents), key=lambda k: (draw[k], k))
    z, n, bias_z, bias_n = Counter(), Counter(), 0.0, 0.0
    al, be, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    weight = lambda f: 0.0 if abs(z[f]) <= l1 else -(z[f] - math.copysign(l1, z[f])) / ((be + math.sqrt(n[f])) / al + l2)
    sigmoid = lambda x: 1 / (1 + math.exp(-min(35, max(-35, x))))
    rng = np.random.default_rng(5)
    known = {k: features(documents[k]) for k in order}
    for _ in range(toxicity.EPOCHS):
        for i in rng.permutation(len(order)).tolist():
            fs, y = known[order[i]], labels[order[i]]
            w, wb = [weight(f) for f in fs], -bias_z / ((be + math.sqrt(bias_n)) / al)
            g = sigmoid(sum(w) + wb) - y
            for f, x in zip(fs, w, strict=True):
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / al * x
                n[f] += g * g
            bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / al * wb
            bias_n += g * g
    bias = -bias_z / ((be + math.sqrt(bias_n)) / al)
    got = {r.doc_id: r for r in result(spark, "op9_toxicity")}
    assert set(got) == set(documents)
    for k, t in documents.items():
        score = sigmoid(bias + sum(map(weight, features(t))))
        assert got[k].score == pytest.approx(score, abs=1e-9) and got[k].held_out == (remainder(k, 5) == 0) and got[k].predicted == int(got[k].score >= 0.5)


def test_op10(spark, documents):
    phrases = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
    got = {r.doc_id: r for r in result(spark, "op10_license_scan")}
    assert set(got) == set(documents)
    for k, t in documents.items():
        w = plain_words(t)
        places = [(i, label) for p, label in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places})))
        assert set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} and r.labels == ",".join(sorted(set(r.labels.split(",")))) and 0 <= r.score <= 1


def test_stages_take_odd_rows(spark):
    """Nulls in any column, empty, repeated and very long texts, and columns whose names the stages use themselves."""
    texts = ["one two three four five six seven eight nine ten", None, "", " ", "12 34", "word " * 200_000, "x" * 300_000, "one two three four five six seven eight nine ten"]
    rows = [(k if k != 3 else None, t, None if k == 2 else "en", None, 1, "s", 3) for k, t in enumerate([*texts, texts[0]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string, sequence_id int").repartition(3)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.count() <= docs.count() and stage(spark, empty, SF).count() == 0
    assert corpus_pipeline.exact_dedup(spark, docs, SF).count() == 6
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and packed.filter("piece = 0").count() == len(rows)
    assert corpus_pipeline.pack(spark, empty, SF).count() == 0


def test_pipeline_leaves_only_its_result(spark):
    out = corpus_pipeline.run(spark, SF)
    left = {root for root in common._OPEN if "/pipeline-" not in root}
    with common.released():
        again = common.Scratch(spark, "probe")
        again.table(spark.range(3), "a")
    assert again.root not in common._OPEN and {root for root in common._OPEN if "/pipeline-" not in root} == left
    assert out.count() > 0
