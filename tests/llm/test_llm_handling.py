"""Cases that earlier tests left out: empty tables, clashing names and very long texts; licence labels against a plain chain."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from seedmill.llm import audit, langid, lexical, licenses, lines, quality, toxicity

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LABELS = "doc_id long, toxic int, quality int, score double, at long"
CLASH = "doc_id long, text string, lang string, source string, toxic int, draw long, pick long, size long, at long, w binary, nk long, pos int, keep binary, spans string, share double, piece binary, ids binary, x string"


def labels(spark, n=0):
    return spark.createDataFrame([(k, k % 2, k % 2, 0.5, 1) for k in range(n)], LABELS)


def clashing(spark, texts):
    rest = (1, 2, 3, 4, 5, b"w", 6, 7, b"k", "s", 0.5, b"p", b"i", "x")
    return spark.createDataFrame([(k, t, "en" if k % 2 else "de", "src", *rest) for k, t in enumerate(texts)], CLASH).repartition(3)


SCORED = {
    "toxicity": lambda d, l: toxicity.score(d, toxicity.fit(d, l, F.lit(True))),
    "quality": lambda d, l: quality.score(d, quality.fit(d, l, F.lit(True))),
    "langid": lambda d, l: langid.classify(d, langid.fit(d, F.lit(True))),
    "audit": lambda d, l: audit.audit(audit.cells(d, l)),
    "lexical": lambda d, l: lexical.search(lexical.build(d), d.select(F.col("doc_id").alias("item_id"), "text", F.lit(1).alias("score"))),
    "licenses": lambda d, l: licenses.scan(d),
    "lines": lambda d, l: lines.apply(d, lines.bitmaps(d)),
}


@pytest.mark.parametrize("name", sorted(SCORED))
def test_empty_documents(spark, name):
    """No document, with and without labels."""
    for known in (labels(spark), labels(spark, 20)):
        assert SCORED[name](clashing(spark, ["a"]).limit(0), known).count() == 0


@pytest.mark.parametrize("name", sorted(SCORED))
def test_clashing_columns(spark, name):
    """Columns under names that the operators use themselves change nothing."""
    texts = [f"word{k % 5} and {'vile' if k % 2 else 'kind'} text number {k}" for k in range(40)] + [None, ""]
    docs = clashing(spark, texts)
    got, want = (sorted(map(str, SCORED[name](d, labels(spark, 40)).collect())) for d in (docs, docs.select("doc_id", "text", "lang", "source")))
    assert got == want and got


def test_very_long_texts(spark):
    """One text of ten megabytes beside short ones, for line dedup and licence scans."""
    phrase = "Released under the MIT License."
    line = "a line of more than forty characters that comes back again"
    long = "\n".join(f"own words of line number {k} in a very long text" for k in range(200_000))
    texts = [f"{long}\n{line}\n{phrase}", *(f"{line}\nrow {k}" for k in range(4)), line, f"{long}\n{line}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in lines.apply(docs, lines.bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()}
    # Lines of the long text are on two documents only; the common line stays in the last one.
    assert [got[k].n_dropped for k in range(7)] == [1, 1, 1, 1, 1, 1, 0] and got[0].n_lines == 200_002
    assert got[0].kept_sha256 == hashlib.sha256(f"{long}\n{phrase}".encode()).hexdigest()
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    n = len(re.findall(WORD, texts[0].translate(LOWER)))
    assert (found[0].n_words, found[0].n_base, found[0].first_word, found[0].labels) == (n, 1, n - 2, ["MIT", "mit"]) and found[6].labels == []


def plain_spans(words, templates, least, gap, cover):
    """Labels of a text: at every word the longest stretch that some template holds; those that can't go on are chained by template."""
    holds = lambda t, s: [i + len(s) - 1 for i in range(len(t) - len(s) + 1) if t[i : i + len(s)] == s]
    size = []
    for k in range(len(words)):
        n = (size[-1] if size else 0) + 1
        while n and not any(holds(t, words[k - n + 1 : k + 1]) for _, t in templates):
            n -= 1
        size.append(n)
    out = set()
    for label, t in templates:
        chains, now = [], None
        for k, n in enumerate(size):
            goes_on = k + 1 < len(size) and size[k + 1] == n + 1
            ends = holds(t, words[k - n + 1 : k + 1]) if n >= least and not goes_on else []
            if not ends:
                continue
            later = [e for e in ends if now and e > now["end"]]
            if later and k - n + 1 - now["last"] <= gap:
                now["covered"] += min(n, k - now["last"], min(later) - now["end"])
                now["last"], now["end"] = k, min(later)
            else:
                now = {"last": k, "end": min(ends), "covered": n}
                chains.append(now)
        if any(min(1.0, c["covered"] / len(t)) >= cover for c in chains):
            out.add(label)
    return out


def test_license_labels_by_a_plain_chain(spark):
    words = lambda t: re.findall(WORD, t.translate(LOWER))
    short = [(label, words(t)) for label, t in licenses.TEMPLATES if len(words(t)) < 60]
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        w = []
        for _ in range(rng.randint(1, 3)):
            _, t = rng.choice(short)
            mine = list(t)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(mine))
                mine[at : at + rng.randint(0, 2)] = [rng.choice(["odd", "words", *t[:3]]) for _ in range(rng.randint(0, 3))]
            w += mine + ["between"] * rng.randint(0, 15)
        texts.append(" ".join(w))
    scanner = licenses.Scanner([(label, " ".join(t)) for label, t in short])
    every = [(label, t) for label, t in short] + [(None, words(p)) for p, _ in licenses.BASE]
    named = 0
    for text in texts:
        ids = [scanner.vocab.get(w.encode(), 0) for w in words(text)]
        _, matches = scanner.stretch(ids, 0)
        got = {scanner.labels[t] for t, *_ in scanner.chain(matches)}
        want = plain_spans(words(text), every, licenses.LEAST, licenses.GAP, licenses.COVER) - {None}
        assert got == want, text
        named += bool(got)
    assert named > 30
