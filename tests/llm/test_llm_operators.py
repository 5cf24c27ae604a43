"""Each operator against a plain version, with odd rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seedmill.llm import decontamination, exact, langid, licenses, lines, packing, simhash, suffixes, token_files, tokens, toxicity
from seedmill.llm.common import Scratch, map_shards
from seedmill.llm.components import components
from seedmill.llm.tokens import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
LOWER = {c: c + 32 for c in range(65, 91)}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = ["The", "alpha", "été", "größe", "x1", "don't", "end.", "a,b", "zwölf", "12"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    odd = [None, "", " ", "\n\n", "İ ΣΑΣ é", "a <|endoftext|> b", "word " * 4000, "\t tab\r\nline", "日本 語.", "x" * 500]
    return made + odd + made[:6]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Columns that clash with the operators' own names stand beside the text."""
    rows = [(k, t, "src", k, None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long, spans string").repartition(3)


def ids_of(text, end):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


def test_word_encoder(texts):
    tok = Tokenizer.from_file(PATH)
    more = ["word,.;", "it's 'quoted' Été-", "<|endoftext|>", "a<|endoftext|>.b", "MIXED <|EndOfText|>", "\u2003wide\u00a0space", "x" * 300, "e\u0301t\u00e9 \u0301", "ÀÖØÞß÷ ×,", ".,.;! a.b"]
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts + more]
    for memo in (tokens.MEMO, 5, 0):
        own = tokens.WordEncoder(PATH)
        own.memo.most = memo
        for part, ids_of_part in ((texts + more, want), (more * 2, want[len(texts) :] * 2)):
            ids, counts = own.encode(pa.array(part, pa.string()))
            assert [ids[e - n : e].tolist() for e, n in zip(np.cumsum(counts), counts, strict=True)] == ids_of_part
    ids, counts = own.encode(pa.array([], pa.string()))
    assert not len(ids) and not len(counts)


def test_word_encoder_in_steps(texts, monkeypatch):
    whole = encoder(PATH).encode(pa.array(texts, pa.string()))
    monkeypatch.setattr(tokens, "STEP", 50)
    for a, b in zip(whole, encoder(PATH).encode(pa.array(texts, pa.string())), strict=True):
        assert (a == b).all()


def test_token_files(docs, texts):
    got = token_files.token_table(docs, PATH).orderBy("doc_id").collect()
    at = 0
    for k, (r, t) in enumerate(zip(got, texts, strict=True)):
        ids = ids_of(t, 1)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (k, at, len(ids), crc(ids), array("I", ids).tobytes())
        at += len(ids)


def test_token_files_in_small_shards(spark, docs, tmp_path):
    token_files.write_tokens(docs, str(tmp_path / "t"), PATH, shard_tokens=100)
    whole = {r.doc_id: r.ids_crc32 for r in token_files.token_table(docs, PATH).collect()}
    rows = {r.doc_id: r for r in token_files.read_tokens(spark, str(tmp_path / "t")).collect()}
    assert {k: r.ids_crc32 for k, r in rows.items()} == whole
    # Random access to some documents.
    some = token_files.read_some(str(tmp_path / "t"), spark.createDataFrame([(k,) for k in (0, 3, 3, 64, 65, 70, 10_000, None)], "doc_id long")).collect()
    assert {r.doc_id: r for r in some} == {k: rows[k] for k in (0, 3, 64, 65, 70)} and len(some) == 5


def test_grammar():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 5000):
        for kinds in (1, 2, 40):
            ids = rng.integers(0, kinds, n).astype(np.uint32)
            symbols, rules, lengths = token_files.repair(ids, 100, least=2)
            assert (token_files.expand(symbols, rules, 100) == ids).all() and (token_files.expand_all(symbols, rules, lengths, 100) == ids).all()
            if n > 10:
                assert (token_files.decode_range(symbols, rules, lengths, 100, 3, 9) == ids[3:9]).all()
    assert len(symbols) < 5000


def test_grammar_ends_when_no_pair_is_frequent():
    """A long repeat becomes a few symbols, and no pair is left at the least count (overlapping ones count once)."""
    rng = np.random.default_rng(2)
    for ids in (np.tile(rng.integers(0, 5000, 700), 400), rng.integers(0, 40, 20_000), np.zeros(5000, np.int64), rng.integers(0, 3, 3000)):
        symbols, rules, lengths = token_files.repair(ids, 5000)
        assert (token_files.expand(symbols, rules, 5000) == ids).all()
        pairs = Counter(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True))
        assert max(pairs.values(), default=0) < token_files.LEAST
    symbols, _, lengths = token_files.repair(np.tile(rng.integers(0, 5000, 700), 400), 5000)
    assert lengths.max() > 64 and len(symbols) < 1000


def test_packing(docs, texts):
    got = packing.pack_documents(docs, PATH, capacity=64).orderBy("doc_id", "piece").collect()
    want = [(k, p, a, len(x := ids[a : a + 64]), crc(x)) for k, t in enumerate(texts) for ids in [ids_of(t, 0)] for p, a in enumerate(range(0, len(ids), 64))]
    assert [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got] == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert len(bins) <= packing.lower_bound(np.array([r.length for r in got]), 64) + 1


def test_packing_rounds_and_bound(spark):
    rng = random.Random(5)
    rows = [(k, 0, rng.choice([30, 35, 40, 50, 64, 3])) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    got = packing.pack(df, 64, rows=400)
    n = got.select("sequence_id").distinct().count()
    least = packing.lower_bound(np.array([r[2] for r in rows]), 64)
    assert got.count() == 3000 and least <= n <= least * 1.02 + 1
    assert packing.lower_bound(np.array([40] * 10), 64) == 10 and packing.lower_bound(np.array([22] * 9), 64) == 5


def repeated(texts, size):
    count = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t) + 1, int)
        for i in range(len(t) - size + 1):
            if count[t[i : i + size]] > 1:
                mark[i] += 1
                mark[i + size] -= 1
        out.append(np.cumsum(mark)[: len(t)] > 0)
    return out


@pytest.mark.parametrize("hot", [1000, 3, 1])
def test_suffix_removals(spark, hot):
    rng = random.Random(hot)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(150)) for _ in range(5)]
    texts = []
    for k in range(90):
        t = "".join(rng.choice("abcdefghijkl ") for _ in range(rng.randint(0, 100)))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(100)
            t += rng.choice(base)[i : i + rng.randint(20, 120)] + rng.choice(["", "x"])
        texts.append(t + ("ab" * 40 if k % 9 == 0 else "") + ("=" * 70 if k % 11 == 0 else ""))
    texts += [None, "", *texts[:4]]
    df = spark.createDataFrame([(None if k == 7 else k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in suffixes.removals(df, 40, hot).collect()}
    for k, (t, mark) in enumerate(zip(texts, repeated([(t or "").encode() for t in texts], 40), strict=True)):
        r = got[None if k == 7 else k]
        raw = np.frombuffer((t or "").encode(), np.uint8)
        assert (r.n_bytes, bytes(r.kept)) == (len(raw), raw[~mark].tobytes())
        assert len(r.spans) == int((np.diff(np.concatenate(([0], mark.astype(int)))) == 1).sum())


def test_suffix_removals_of_repeated_ids(spark):
    """Rows of one doc_id with different texts are documents of their own; a repeated row is a copy."""
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    s, *r = text(60), *(text(150) for _ in range(5))
    rows = [(1, s + r[0]), (1, r[1]), (2, r[2] + s), (None, r[3] + s), (None, r[4]), (7, r[1][:30]), (8, "x" + r[0]), (8, "x" + r[0])]
    got = {(x.doc_id, x.n_bytes, bytes(x.kept)) for x in suffixes.removals(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()}
    marks = repeated([t.encode() for _, t in rows], 40)
    assert got == {(k, len(t), np.frombuffer(t.encode(), np.uint8)[~m].tobytes()) for (k, t), m in zip(rows, marks, strict=True)}


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(150):
        x = bytes(rng.choice(b"abc" if rng.random() < 0.5 else b"ab=cdefgh") for _ in range(rng.randint(0, 200))) + b"\xff"
        wanted = np.array([rng.random() < rng.choice([0.1, 0.5, 1.0]) for _ in x])
        assert suffixes.suffix_array(np.frombuffer(x, np.uint8), wanted, 500).tolist() == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: x[i:])


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    rng = random.Random(4)
    t = "".join(rng.choice("abcdefgh") for _ in range(5000))
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    whole, out = suffixes._anchor_rows(40), []
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 0]), pa.array([t, t[100:4000]])], ["doc_id", "nk", "text"])
    for size in (1000, 1 << 20):
        monkeypatch.setattr(suffixes, "PIECE", size)
        out.append(sorted(tuple(r.values()) for b in whole(iter([batch])) for r in b.to_pylist()))
    assert out[0] == out[1] and len(out[0]) > 200


def test_decontamination(spark):
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(30)] + ["é", "Zoo"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([14, 25, 10, 3, 1, 12])] + [(90, None), (91, ""), (92, "...")]
    texts = []
    for k in range(70):
        t = " ".join(rng.choice(vocab[:8] if k % 7 == 0 else vocab) for _ in range(rng.randint(0, 40)))
        if k % 3 == 0:
            t += ", " + rng.choice([x for _, x in items[:6]]).upper() + ". " + t
        texts.append(t)
    texts += [None, "", *texts[:3]]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(WORD, (t or "").translate(LOWER))
    for window, size, shard in ((10, 1 << 20, 1 << 20), (4, 60, 300)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        try:
            got = {r.doc_id: r for r in decontamination.find(docs, bench, window, block_bytes=size, shard_bytes=shard).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == len(texts)
        for k, t in enumerate(texts):
            w, hit, found = words(t), set(), set()
            for i, x in items:
                v = words(x)
                for a in range(max(1, len(v) - window + 1) if v else 0):
                    p = v[a : a + window]
                    for b in range(len(w) - len(p) + 1):
                        if w[b : b + len(p)] == p:
                            hit |= set(range(b, b + len(p)))
                            found.add(str(i))
            r = got[k]
            assert (r.n_words, sum(s.words for s in r.spans), r.items) == (len(w), len(hit), sorted(found))
            raw = (t or "").encode()
            for s in r.spans:
                assert words(raw[s.start : s.end].decode()) == w[s.first : s.first + s.words]
    assert decontamination.clean(docs, bench).columns == docs.columns


def test_map_shards():
    batches = [pa.RecordBatch.from_pydict({"x": pa.array(range(a, a + n), pa.int64())}) for a, n in ((0, 3), (3, 0), (3, 5), (8, 1), (9, 2))]
    got = [b.column(0).to_pylist() for b in map_shards(lambda b: b, 40)(iter(batches))]
    assert got == [[0, 1, 2, 3, 4, 5, 6, 7], [8, 9, 10]]
    assert list(map_shards(lambda b: b, 40)(iter(batches[1:2]))) == []


def test_windows_stay_small():
    """A block's arrays stay within a small multiple of its bytes, on the driver and when sent."""
    import pickle
    import tracemalloc

    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(5000)]
    items = [(k, " ".join(rng.choices(vocab, k=100))) for k in range(1500)]
    n = sum(len(t) for _, t in items)
    tracemalloc.start()
    held = decontamination.Windows(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * n and len(pickle.dumps(held)) < 40 * n
    assert held.holders(10, 0) == ["0"] and len(held.patterns[10]) == 1500 * 91


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    s = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, distance=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(fps))]


def test_simhash(docs, texts):
    got = {r.doc_id: r for r in simhash.groups(docs).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert [got[k].fp % (1 << 64) for k in range(len(texts))] == fps
    assert [got[k].component_id for k in range(len(texts))] == plain_components(fps)


@pytest.mark.parametrize("hot", [20_000, 60])
def test_simhash_links(spark, hot):
    """Dense clusters: small buckets, large ones, and those dealt out as blocks."""
    rng = random.Random(hot)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centres for _ in range(200)} | {rng.getrandbits(64) for _ in range(100)} | {0, 1, (1 << 64) - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(5)
    scratch = Scratch(spark, "test")
    root = {r.node: r.root for r in components(simhash.links(df, scratch, hot=hot), scratch).collect()}
    ours = {}
    for f in signed:
        ours.setdefault(root.get(f, f), set()).add(f)
    plain = {}
    for f, c in zip(signed, plain_components(fps), strict=True):
        plain.setdefault(c, set()).add(f)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, plain.values()))


def test_language_id(spark):
    rng = random.Random(3)
    kinds = {"a": ["ba", "lo", "mi", "ke"], "b": ["stra", "gni", "vor", "zt"], "c": ["eau", "qui", "ment", "ère"]}
    rows = [(k, " ".join("".join(rng.choice(kinds[lang]) for _ in range(3)) for _ in range(60)), lang) for k, lang in enumerate(["a", "b", "c"] * 40)]
    rows += [(500, None, "a"), (501, "12 34", "b"), (502, "", None), (503, "é", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in langid.classify(df, model).collect()}
    assert all(got[k].lang_pred == lang and not got[k].rejected for k, _, lang in rows if k < 500)
    assert [got[k].lang_pred for k in (500, 501, 502)] == ["und"] * 3 and got[503].lang_pred in kinds
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = langid.fit(df.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.classify(df, nothing).collect()} == {"und"}
    assert langid.keep_column(df, model, "keep").filter("keep").count() >= 120


def test_language_id_learns_long_texts(spark):
    """Languages with long texts only, with one short text among long ones, or with a tiny text are learned too."""
    rng = random.Random(4)
    kinds = {"a": ["ba", "lo", "mi", "ke"], "b": ["stra", "gni", "vor", "zt"], "c": ["eau", "qui", "ment", "ère"]}
    text = lambda lang, n: " ".join("".join(rng.choice(kinds[lang]) for _ in range(3)) for _ in range(n))
    rows = [(k, text("a", 60), "a") for k in range(100)] + [(100 + k, text("b", 1500), "b") for k in range(20)] + [(200 + k, text("c", 1500) if k else text("c", 4), "c") for k in range(20)]
    rows += [(300, "日本", "d")] + [(None, text("a", 1500), "a")] * 50
    assert all(len(t.encode()) > langid.DICT_BYTES // 16 for _, t, lang in rows if lang == "b")
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), F.lit(True))
    assert model.names == ("a", "b", "c", "d") and all(8 <= len(c) <= langid.DICT_BYTES for c in model.contents)
    assert len(model.contents[2]) > 10_000 and [c.decode() for c in model.contents]
    new = [(k, text(lang, 40), lang) for k, lang in enumerate("abc" * 10)]
    got = {r.doc_id: r.lang_pred for r in langid.classify(spark.createDataFrame(new, "doc_id long, text string, lang string"), model).collect()}
    assert all(got[k] == lang for k, _, lang in new)


def test_language_id_rejects_narrow_margins(spark):
    """By encodings of given sizes, and texts of a language that was left out of the fit."""
    fake = lambda n: type("E", (), {"compress": lambda self, raw: b"x" * n})()
    rejected = lambda a, b: langid.judge(b"x" * 400, ("a", "b"), [fake(a), fake(b)])[2]
    assert rejected(100, 101) and rejected(50, 52) and not rejected(50, 53) and rejected(300, 305) and not rejected(300, 307)
    rng = random.Random(5)
    kinds = {"a": ["ba", "lo", "mi", "ke"], "b": ["stra", "gni", "vor", "zt"], "c": ["eau", "qui", "ment", "ère"], "none": ["xu", "wy", "jo", "pha"]}
    text = lambda lang: " ".join("".join(rng.choice(kinds[lang]) for _ in range(3)) for _ in range(60))
    rows = [(k, text(lang), None if lang == "none" else lang) for k, lang in enumerate(["a", "b", "c", "none"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.rejected for r in langid.classify(df, langid.fit(df, F.col("doc_id") < 80)).collect()}
    new = [(got[k], lang) for k, _, lang in rows if k >= 80]
    assert sum(r for r, lang in new if lang is None) >= 10 and not any(r for r, lang in new if lang)


def test_exact(spark):
    texts = ["a b", "a  b", "a\tb\n", "a b ", None, "", " ", "\n\n", "a\xa0b", "x" * 100_000, "x" * 100_000, "a b"]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(0, "a b", 1)], "doc_id long, text string, h int").repartition(4)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for r in exact.groups(df, capacity=50).collect():
        same = [k for k, n in enumerate(norm) if n == norm[r.doc_id]]
        extra = int(norm[r.doc_id] == "a b")
        assert (r.keep_id, r.group_size, r.kept, bytes(r.sha)) == (same[0], len(same) + extra, r.doc_id == same[0], hashlib.sha256(norm[r.doc_id].encode()).digest())


def test_exact_chains_collisions(spark, monkeypatch):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "b", "a", "c", "b"])], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(exact, "key_of", lambda text: 5)
    import pyarrow as pa

    rows = []
    fake = type("D", (), {"sparkSession": spark, "mapInArrow": lambda self, f, s: (rows.append(f), self)[1], "repartition": lambda self, *a: self, "sortWithinPartitions": lambda self, *a: self})()
    exact.index(fake, np.zeros(1, np.int32), 0)
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2, 3, 4]), pa.array(["a", "b", "a", "c", "b"])], ["doc_id", "text"])
    out = [r for b in rows[1](rows[0](iter([batch]))) for r in b.to_pylist()]
    assert {r["bucket"] for r in out} == {0} and [(r["chain"], r["keep_id"], r["group_size"]) for r in out] == [(0, 0, 2), (1, 1, 2), (2, 3, 1)] and df.count() == 5


def test_directory_splits(spark):
    df = spark.createDataFrame([(k * ((1 << 64) // 500) - (1 << 63), 100) for k in range(500)], "h long, n_bytes long")
    buckets, bits = exact.directory(df, capacity=2000, depth=12)
    held = Counter(int(buckets[(h % (1 << 64)) >> (64 - bits)]) for h, _ in df.collect())
    assert len(buckets) == 1 << bits and max(held.values()) <= 20


def plain_lines(texts, least_chars, least_docs):
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate(LOWER)
    held = {}
    for k, t in texts:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least_chars and k is not None:
                held.setdefault(key(x), set()).add(k)
    return [(k, len(s := (t or "").split("\n")), "\n".join(x for x in s if len(held.get(key(x), ())) < least_docs or k is None or k == max(held[key(x)]))) for k, t in texts]


@pytest.mark.parametrize("parts", [1, 7])
def test_lines(spark, parts):
    rng = random.Random(parts)
    pool = ["a common line of text", "Another COMMON line  ", "été à la même page", "short", ""]
    texts = [(k, "\n".join(rng.choice(pool[: 1 + k % 5] + [f"own line number {k}"]) for _ in range(rng.randint(0, 9)))) for k in range(80)] + [(100, None), (101, ""), (None, "a common line of text")]
    df = spark.createDataFrame([(k, t, 0) for k, t in texts], "doc_id long, text string, pos int").repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        kept = lines.bitmaps(df, 10, 5)
        got = {r.doc_id: (r.n_lines, bytes(r.kept_text).decode()) for r in lines.apply(df, kept).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {k: (n, t) for k, n, t in plain_lines(texts, 10, 5)}


def test_lines_of_repeated_ids(spark):
    """Rows of one doc_id count as one document and lose their own lines only; a repeated row loses the same."""
    often = "a line that many documents hold"
    rows = [(0, "unique first line\nsecond"), (0, f"{often}\nunique"), (0, f"{often}\nunique"), (1, f"x\n{often}"), (1, often), (2, often), (3, often), (9, often), (9, f"y\n{often}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_lines, bytes(r.kept_text).decode()) for r in lines.apply(df, lines.bitmaps(df, 10, 5)).collect())
    assert got == sorted((k, len(t.split("\n")), t if k == 9 else "\n".join(x for x in t.split("\n") if x != often)) for k, t in rows)
    assert {r.doc_id for r in lines.bitmaps(df, 10, 6).collect()} == set()


def test_toxicity(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(600):
        w = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        bad = k % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "nasty"]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    rows += [(900, None), (901, "")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [k for k in range(0, 600, 5)]
    assert sum(got[k].predicted == labels[k][1] for k in held) / len(held) > 0.95
    assert got[900].score == got[901].score and all(0 <= r.score <= 1 for r in got.values())
    assert len(model[1]) < 50_000
    none = toxicity.fit(docs, known.limit(0), F.lit(True))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}


def test_toxicity_with_long_and_repeated_texts(spark, monkeypatch):
    """Neither a long text nor an id with many rows ends the sample."""
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 40_000)
    assert [toxicity.fair_share(x, 100) for x in ([10, 20], [10, 80, 80], [500], [])] == [20, 45, 100, 0]
    rows = [(k, ("bad awful words here " if k % 2 else "nice kind words there ") + f"x{k}") for k in range(200)]
    rows += [(k, "calm " * 20_000) for k in range(200, 230)] + [(300, f"calm again {k} " * 20) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = spark.createDataFrame([(k, k % 2 if k < 200 else 0) for k in [*range(230), 300]], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, known, F.lit(True))).collect()}
    assert all(got[k] == k % 2 for k in range(200)) and got[300] == 0


def test_licenses(spark):
    notice = licenses.TEMPLATES[1][1]
    texts = ["Released under the MIT License.", notice, notice.replace("merge, publish", "merge, quickly publish"), "apache license MIT-license general public license mit license", "license mit", None, "", "The General\nPublic  License!"]
    df = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(texts)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for k, t in enumerate(texts):
        w = re.findall(WORD, (t or "").translate(LOWER))
        places = [(a, label) for p, label in licenses.BASE for a in range(len(w)) if w[a : a + len(p.split())] == p.split()]
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min((a for a, _ in places), default=None), max((a for a, _ in places), default=None), sorted({x for _, x in places}))
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    assert got[0].labels == ["MIT", "mit"] and got[1].labels == got[2].labels == ["MIT"] and got[5].labels == []


def test_matching_statistics():
    rng = random.Random(8)
    sets = [[rng.randrange(1, 5) for _ in range(rng.randint(1, 12))] for _ in range(6)]
    a = licenses.Automaton()
    for s in sets:
        a.add(s)
    text = [rng.randrange(1, 6) for _ in range(200)]
    state = size = 0
    for k, c in enumerate(text):
        state, size = a.step(state, size, c)
        longest = max((n for n in range(13) if any(text[k + 1 - n : k + 1] == s[i : i + n] for s in sets for i in range(len(s) - n + 1)) and n <= k + 1), default=0)
        assert size == longest


EMPTY = {
    "token_files": lambda d, b: token_files.token_table(d, PATH), "packing": lambda d, b: packing.pack_documents(d, PATH), "suffixes": lambda d, b: suffixes.removals(d),
    "decontamination": lambda d, b: decontamination.find(d, b), "simhash": lambda d, b: simhash.groups(d), "exact": lambda d, b: exact.groups(d),
    "lines": lambda d, b: lines.apply(d, lines.bitmaps(d)), "licenses": lambda d, b: licenses.scan(d), "langid": lambda d, b: langid.classify(d, langid.Model((), ())),
}


@pytest.mark.parametrize("name", sorted(EMPTY))
def test_empty_tables_and_null_ids(spark, name):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert EMPTY[name](docs, bench).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, None), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert EMPTY[name](odd, bench).count() == 4
