"""Ranked search, quality and the filter audit against plain versions, with odd rows."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedmill.llm import audit, lexical, quality, queries

SF = "/root/testdata/sf0.001"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = {c: c + 32 for c in range(65, 91)}
#: Columns that clash with those the operators add.
CLASH = "doc_id long, text string, source string, n long, score double, mask int, rank int, part string, x string"


def terms(text):
    return re.findall(TERM, (text or "").translate(LOWER))


def ranked(docs, items, k=10):
    """Plain scores over all pairs: item -> [(rank, doc_id, score)]; ids may repeat or be None."""
    lists = [(i, terms(t)) for i, t in docs]
    lists = [(i, w, Counter(w)) for i, w in lists if w]
    n_docs, n_terms = len(lists), sum(len(w) for _, w, _ in lists)
    df = Counter(t for _, _, c in lists for t in c)
    own = {}
    for i, t in items:
        own.setdefault(i, set()).update(terms(t))
    out = {}
    for i, ts in own.items():
        found = []
        for d, w, c in lists:
            m = 100 - 90 + (90 * len(w) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0))
        if found:
            out[i] = [(r + 1, None if u else d, -s) for r, (s, u, d) in enumerate(sorted(found)[:k])]
    return out


def rows_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r.item_id), r.rank)):
        out.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(40)] + ["The", "ÉTÉ", "été", "größe", "日本"]
    made = [" ".join(vocabulary[int(rng.paretovariate(0.5)) % len(vocabulary)] for _ in range(rng.randint(0, 90))) for _ in range(150)]
    odd = [None, "", " .,; ", "w1 " * 5000, "The the THE", "\x00w2\x7fw3", "x" * 300]
    # A third of all rows are copies: equal scores.
    return made + odd + [made[0]] * 80


ITEMS = [(1, "w1 w2 w3 the"), (2, None), (3, "... "), (4, "nowhere at all"), (5, "ÉTÉ été größe w9 w9 W9"), (6, "w17"), (6, "w18 w19"), (None, "w5 w6"), (7, " ".join(f"w{k}" for k in range(40)))]


@pytest.mark.parametrize("shard_bytes", [1, 2_000, lexical.SHARD_BYTES])
def test_ranked_search(spark, texts, shard_bytes):
    ids = [k if k % 11 else None for k in range(len(texts))]
    ids[20:24] = [5, 5, -7, 2**40]
    docs = spark.createDataFrame([(i, t, "s", 1, 0.5, 2, 3, "p", "x") for i, t in zip(ids, texts)], CLASH).repartition(3)
    items = spark.createDataFrame([(i, t, 9, 0.1) for i, t in ITEMS], "item_id long, text string, rank int, score double")
    want = ranked(list(zip(ids, texts)), ITEMS)
    assert set(want) == {1, 5, 6, 7, None}
    index = lexical.build(docs, shard_bytes=shard_bytes)
    got = lexical.search(index, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and rows_of(got) == want
    # Items in several blocks, and other numbers of results, from the same index.
    assert rows_of(lexical.search(index, items, item_bytes=20)) == want
    assert rows_of(lexical.search(index, items, k=3)) == ranked(list(zip(ids, texts)), ITEMS, 3)


def test_ranked_search_opens_only_some_nodes(texts, monkeypatch):
    """Bounds are never under a document's score, and a rare term keeps most of the tree closed."""
    import pyarrow as pa

    made = [t for t in texts if t and terms(t)] * 8
    n_docs, n_terms = len(made), sum(len(terms(t)) for t in made)
    shard = lexical._shard(pa.RecordBatch.from_pydict({"doc_id": list(range(len(made))), "text": made}), n_docs, n_terms).to_pylist()[0]
    tree = lexical._Tree(shard, n_docs, n_terms)
    local = {t: k for k, t in enumerate(shard["terms"].split())}
    opened = []
    whole = tree._sum
    monkeypatch.setattr(tree, "_sum", lambda *a: opened.append(len(a[0])) or whole(*a))
    monkeypatch.setattr(lexical, "OPEN", 4)
    rare = [min((t for t in local), key=lambda t: tree.starts[local[t] + 1] - tree.starts[local[t]])]
    top = tree.best(np.array([local[t] for t in rare]), np.array([1000]), [], 3)
    assert len(top) == 3 and sum(opened) < len(made)


def test_ranked_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha"), (2, None)], "item_id long, text string")
    assert rows_of(lexical.search(lexical.build(docs), items)) == ranked([(1, "alpha beta"), (2, None), (3, "")], [(1, "alpha"), (2, None)])
    assert lexical.search(lexical.build(docs.limit(0)), items).count() == 0
    assert lexical.search(lexical.build(docs.filter("doc_id > 1")), items).count() == 0
    assert lexical.search(lexical.build(docs), items.limit(0)).count() == 0


def test_op11(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows_of(queries.op11_ranked_search(spark, SF)) == ranked(docs, items)


# Quality


def plain_margin(model, x):
    """One row through each tree, node by node."""
    total = model.bias
    for t in range(model.feature.shape[0]):
        at, inner = 0, model.feature.shape[1]
        while at < inner:
            at = 2 * at + 1 + int(x[model.feature[t, at]] > model.threshold[t, at])
        total += model.leaf[t, at - inner]
    return total


def test_trees_learn_and_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    x[:, 3] = np.round(x[:, 3])
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = quality.grow(x[:3000], y[:3000], trees=40)
    p = model.score(x[3000:])
    assert ((p > 0.5) == (y[3000:] == 1)).mean() > 0.97
    assert np.allclose(model.margin(x[:50]), [plain_margin(model, r) for r in x[:50]])


def test_first_split_is_the_best_of_all():
    """The first tree's root against every cut of every statistic, taken one by one."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(60, 3)), 1)
    y = (x[:, 1] + 0.3 * rng.normal(size=60) > 0.2).astype(float)
    p = y.mean()
    g, h = p - y, np.full(60, p * (1 - p))
    value = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.L2)
    cuts = {(f, c): value(x[:, f] <= c) + value(x[:, f] > c) for f in range(3) for c in np.unique(x[:, f])[:-1] if min(h[x[:, f] <= c].sum(), h[x[:, f] > c].sum()) >= quality.LEAST_HESSIAN}
    model = quality.grow(x, y, trees=1, depth=1, bins=200)
    assert cuts[int(model.feature[0, 0]), float(model.threshold[0, 0])] == pytest.approx(max(cuts.values()))


def test_statistics():
    named = dict(zip(quality.FEATURES, quality.statistics("Ab cd cd, 1é\nAb".encode()), strict=True))
    assert named["words"] == pytest.approx(math.log(6)) and named["lines"] == pytest.approx(math.log(3))
    assert named["distinct_words"] == 4 / 5 and named["top_word"] == 2 / 5 and named["same_as_before"] == 0 and named["upper"] == 2 / 16
    assert quality.statistics(b"") == [0.0] * len(quality.FEATURES)
    assert len(quality.statistics(b"word " * 200_000)) == len(quality.FEATURES)


def test_quality(spark):
    rng = random.Random(4)
    good = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) + "." for _ in range(150)]
    bad = [" ".join(["spam", "spam", "ham"][rng.randrange(3)] for _ in range(60)) for _ in range(150)]
    rows = [(k, t, "s", 1, 0.5, 2, 3, "p", "x") for k, t in enumerate([v for pair in zip(good, bad) for v in pair])]
    rows += [(None, None, None, None, None, None, None, None, None), (900, "", "s", 1, 0.5, 2, 3, "p", "x"), (901, "word " * 200_000, "s", 1, 0.5, 2, 3, "p", "x"), rows[0], (2, bad[0], "s", 1, 0.5, 2, 3, "p", "x")]
    docs = spark.createDataFrame(rows, CLASH).repartition(3)
    labels = spark.createDataFrame([(k, 1 - k % 2, "z") for k in range(200)] + [(3, 0, "z"), (7, None, "z"), (None, 1, "z")], "doc_id long, quality int, text string")
    model = quality.fit(docs, labels, F.lit(True))
    got = quality.score(docs, model)
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == len(rows)
    scores = {r.doc_id: r for r in got.collect()}
    assert all(scores[k].predicted == 1 - k % 2 == int(scores[k].score >= quality.PASS_AT) for k in range(200, 300))
    # No labels, labels of one kind, no documents.
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0), F.lit(True))).collect()} == {1 / (1 + math.exp(-35))}
    assert all(r.predicted == 0 for r in quality.score(docs, quality.fit(docs, labels.filter("quality = 0"), F.lit(True))).collect())
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels, F.lit(True))).count() == 0


def test_quality_fit_does_not_depend_on_partitions(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    one, many = (quality.fit(docs.repartition(n), labels, F.lit(True)) for n in (1, 7))
    assert np.array_equal(one.feature, many.feature) and np.array_equal(one.threshold, many.threshold) and np.array_equal(one.leaf, many.leaf)


def test_op12_held_out(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op12_quality(spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert len(rows) == 1000 and len(held) > 80 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.97 * len(held)


# Filter audit


def plain_audit(rows, labels):
    """Every order applied to every document, one after the other."""
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, t in labels if t == 1} - {None}
    fails = []
    for d, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": d is not None and any(o is not None and o < d and (x or "") == t for o, x, _ in rows),
        }
        fails.append((s or "", own, d))
    out = {}
    for part in {s for s, _, _ in fails}:
        own = [(f, d) for s, f, d in fails if s == part]
        sums = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(own)
            gone = []
            for step, x in enumerate(order, 1):
                lost = [(f, d) for f, d in left if f[x]]
                redundant = sum(f[x] for f, _ in gone)
                left, gone = [(f, d) for f, d in left if not f[x]], gone + lost
                sums[x] += len(lost)
                unique = sum(f[x] and sum(f.values()) == 1 for f, _ in own)
                out[part, order, step] = [len(left), len(lost), redundant, unique, sum(d in good for _, d in lost), sum(d in toxic for _, d in lost)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(sums[order[step - 1]])
    return out


def audited(docs, labels):
    names = [c.split()[0] for c in audit.AUDIT.split(", ")]
    got = audit.audit(audit.cells(docs, labels))
    assert got.columns == names
    rows = [tuple(r) for r in got.collect()]
    assert len({r[:3] for r in rows}) == len(rows)
    return {r[:3]: list(r[3:]) for r in rows}


def test_audit(spark):
    rng = random.Random(6)
    words = ["alpha", "Beta", "GAMMA", "d|e", "f#", "g", "été", "Ö"] + [f"w{k}" for k in range(80)]
    made = [" ".join(rng.choice(words[rng.randrange(80) :]) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    odd = [None, "", "\x0b\x0c", "É" * 30, "A" * 400, "word " * 50_000, "a b " * 60]
    texts = made + odd + [made[1]] * 40 + [None, ""]
    sources = ["s1", "s2", None, "", "s3"]
    rows = [(k if k % 7 else None, t, sources[k % 5]) for k, t in enumerate(texts)]
    # One id on many texts, and repeated rows.
    rows += [(500, t, "s1") for t in made[:30]] + [(501, made[1], "s2")] * 3 + [(-4, made[2], "s1"), (-4, made[2], "s2")]
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 110, 3)] + [(500, 1, 1), (500, 0, None), (None, 1, 1), (9, None, 1), (8000, 1, 1)]
    docs = spark.createDataFrame([(d, t, s, 1, 0.5, 2, 3, "p", "x") for d, t, s in rows], CLASH).repartition(3)
    known = spark.createDataFrame([(*x, 7) for x in labels], "doc_id long, quality int, toxic int, mask int")
    assert audited(docs, known) == plain_audit(rows, labels)
    none = audited(docs, known.limit(0))
    assert none == plain_audit(rows, [])
    assert audited(docs.limit(0), known) == {}


def test_audit_deals_out_hot_ids(spark):
    """A third of the rows without id, and a third under one id, all with texts of their own, do not meet in one task."""
    n = 30_000
    docs = spark.range(n).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 7 else id end doc_id", "concat('text ', id) text", "'s' source")
    spread = audit.masks(docs).withColumn("spread", F.when(F.col("doc_id").isNull(), F.col("lo")).otherwise(0)).filter("doc_id is null").repartition(8, "doc_id", "spread")
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < n / 3 / 4
    got = audited(docs, spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int"))
    assert got["s", "ABCDE", 1][:2] == [0, n] and got["s", "ABCDE", 1][4] == n // 3


def test_walk_visits_every_order_once():
    orders = [tuple(o) for o, _ in audit.walk(np.zeros((3, audit.CELLS, 1), np.int64))]
    assert len(orders) == len(set(orders)) == math.factorial(5)
    for a, b in itertools.pairwise(orders):
        moved = [k for k in range(5) if a[k] != b[k]]
        assert len(moved) == 2 and moved[1] == moved[0] + 1
