"""Stop strings over pieces, the context's clamp, budgets of requests, commits of files, a real vocabulary, blocks in turn."""

import json
import os
import random
import re
import shutil
import threading
import time

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seedmill import queries
from seedmill.backends import generation, services
from seedmill.functions import prompts
from seedmill.operators import decontam, dedup
from seedmill.plans import stages
from seedmill.sources import commits, files
from seedmill.streaming import resumable

SF = "/root/testdata/sf0.001"


def first_stop(text, stops):
    """(start, end) of the stop that is complete first; of several that end together the longest."""
    ends = [(m.end(), -len(s)) for s in stops for m in re.finditer(f"(?={re.escape(s)})", text) for m in [re.compile(re.escape(s)).match(text, m.start())]]
    return (min(ends)[0] + min(ends)[1], min(ends)[0]) if ends else None


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=40), st.lists(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=4), st.integers(1, 7), st.integers(0, 20))
def test_pieces_are_cut_as_the_whole_text_would_be(text, stops, size, most):
    pieces = [text[k : k + size] for k in range(0, len(text), size)]
    reason, got = generation.assemble(pieces, generation.Stops(stops), most)
    shown = "".join(pieces[:most])
    found = first_stop(shown, stops)
    assert (reason, got) == (("stop", shown[: found[0]]) if found else ("length" if len(pieces) > most else "eos_token", shown))


def test_nothing_is_asked_for_after_a_stop():
    asked = []

    def pieces():
        for p in ("ab", "c#", "##", "never"):
            asked.append(p)
            yield p

    assert generation.assemble(pieces(), generation.Stops(["###"]), 99) == ("stop", "abc") and asked == ["ab", "c#", "##"]
    with pytest.raises(ValueError):
        generation.Stops([""])


def test_generation_in_a_stage(spark):
    def spell(prompt, seed, sampling):
        if "fail" in prompt:
            raise RuntimeError("broken")
        return iter(f"{seed}: loops, sums\n## next")

    rows = spark.createDataFrame([(0, "x"), (1, "fail"), (2, "y" * 5000), (3, "z")], "pos long, seed string").repartition(2)
    sampling = services.Sampling(max_tokens=50, n=2, stop=("\n##",))
    shots = prompts.Fewshots({"S->C": "List."}, (prompts.Example("c", "Python", ("a",), "easy", "s", "i", None, "r"),))
    model = generation.Generator(spell, F.length, 2000, sampling)
    done = {r.pos: r for r in stages.generate(rows, "S->C", shots, model, 1, 10).collect()}
    assert set(done) == {0, 3} and done[3].concepts == ["13: loops", "sums"]
    # Room: the context, the most new tokens, and the most in all, whichever is least; a full prompt is an error.
    df = spark.createDataFrame([("a" * n, 0) for n in (5, 90, 96, 100, 101)] + [(None, 0)], "prompt string, seed_value int")
    got = generation.Generator(spell, F.length, 100, services.Sampling(max_tokens=8), most=98).apply(df).collect()
    assert [(len(r.choices[0].text), r.choices[0].finish_reason) if r.choices else r.error for r in got] == [(8, "length"), (8, "length"), (2, "length"), "the prompt fills the context", "the prompt fills the context", "no prompt"]


def test_bucket():
    at, slept = [0.0], []
    bucket = generation.Bucket(4.0, lambda: at[0], slept.append)
    for _ in range(3):
        bucket.take()
    at[0] = 10.0
    bucket.take()
    assert slept == [0.25, 0.5]


@pytest.mark.parametrize("tasks", [1, 3, 4])
def test_requests_stay_under_the_budget(spark, tasks):
    """The most requests in any second, over all tasks and threads."""
    moment = lambda prompt, seed, sampling: [("stop", repr(time.time()))]
    rate = 40.0
    rows = spark.range(100).selectExpr("cast(id as string) prompt", "id seed_value").repartition(7)
    done = generation.Limited(moment, in_flight=8, per_second=rate, tasks=tasks).apply(rows).collect()
    times = sorted(float(r.choices[0].text) for r in done)
    busiest = max(sum(a <= t < a + 1 for t in times) for a in times)
    assert len(times) == 100 and busiest <= rate + tasks + 2 and times[-1] - times[0] > 100 / rate * 0.8


def ids(df):
    return sorted(r.id for r in df.collect())


def test_commits(spark, tmp_path):
    t = commits.Table(spark, str(tmp_path / "t"))
    assert ids(t.read("id long")) == [] and t.state()[0] == -1 and t.vacuum() == 0
    t.guard("abc12", 5)
    t.guard("other", 5, ignore_fingerprint=True)
    for settings_ in (("other", 5), ("abc12", 6)):
        with pytest.raises(ValueError):
            t.guard(*settings_)
    t.write(spark.range(2), chunk=0)
    t.write(spark.range(10, 12), chunk=1)
    t.write(spark.range(20, 22), chunk=1)  # a repeated chunk
    assert ids(t.read("id long")) == [0, 1, 20, 21]
    before = t.read("id long")
    # Cached rows come from the table that is replaced, with the new rows in the same commit.
    t.write(before.filter("id < 2"), replace=True, more=[spark.range(30, 31)])
    assert ids(t.read("id long")) == [0, 1, 30] and ids(before) == [0, 1, 20, 21]
    assert t.vacuum() == 3 and ids(t.read("id long")) == [0, 1, 30]
    t.guard("abc12", 5)
    t.write(spark.range(0), chunk=7)
    assert ids(t.read("id long")) == [0, 1, 30]


def test_a_killed_writer_leaves_nothing_that_counts(spark, tmp_path, monkeypatch):
    t = commits.Table(spark, str(tmp_path / "t"))
    t.write(spark.range(3), chunk=0)
    monkeypatch.setattr(commits.Table, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        t.write(spark.range(3, 6), chunk=1)
    monkeypatch.undo()
    assert ids(t.read("id long")) == [0, 1, 2] and len(os.listdir(tmp_path / "t/data")) == 2
    t.write(spark.range(3, 6), chunk=1)
    assert ids(t.read("id long")) == [0, 1, 2, 3, 4, 5] and t.vacuum() == 1


def test_of_two_writers_one_wins(spark, tmp_path):
    t = commits.Table(spark, str(tmp_path / "t"))
    t.write(spark.range(1))
    number, manifest = t.state()
    results = []

    def commit():
        try:
            t._commit(number + 1, manifest)
            results.append("won")
        except commits.Conflict:
            results.append("lost")

    threads = [threading.Thread(target=commit) for _ in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert sorted(results) == ["lost"] * 3 + ["won"]
    assert sorted(n for n in os.listdir(tmp_path / "t/_manifest") if not n.startswith(".")) == [f"{k:012d}.json" for k in range(2)]


def test_a_stream_into_commits(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k in range(4):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"id": 10 * k + i}) for i in range(3)))
    table = commits.Table(spark, out)
    args = (spark, str(source), "id long", lambda df: df.filter("id % 2 = 0"), out)
    resumable.run(*args, str(tmp_path / "c"), 1, table=table).awaitTermination()
    want = [k for k in range(34) if k % 10 < 3 and k % 2 == 0]
    assert ids(table.read("id long")) == want and [f["chunk"] for f in table.state()[1]["files"]] == [0, 1, 2, 3]
    # A stream that has lost its checkpoint repeats its chunks; each counts once.
    shutil.rmtree(tmp_path / "c")
    resumable.run(*args, str(tmp_path / "c2"), 1, table=table).awaitTermination()
    assert ids(table.read("id long")) == want


def test_cached_rows_may_come_from_the_target(spark, tmp_path):
    path = str(tmp_path / "r")
    files.write_jsonl(spark.range(4), path)
    held = spark.read.schema("id long").json(path)
    files.write_after_cached(held.filter("id < 2"), spark.range(7, 9), path)
    assert ids(spark.read.schema("id long").json(path)) == [0, 1, 7, 8] and os.listdir(tmp_path) == ["r"]


def test_guard_takes_a_folder_without_a_row(spark, tmp_path):
    (tmp_path / "out/_manifest").mkdir(parents=True)
    resumable.guard(spark, str(tmp_path / "out"), "abc12", 5)
    with pytest.raises(ValueError):
        resumable.guard(spark, str(tmp_path / "out"), "abc12", 6)


# A real vocabulary.


@pytest.fixture(scope="module")
def plain(spark):
    """Supervised rows in plain Python."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = tok.token_to_id("<|endoftext|>")
    out = {}
    for r in queries.responses(spark, SF).collect():
        p = tok.encode(f"{prompts.SYSTEM}\n\n### Instruction\n{r.instruction}\n\n### Response\n", add_special_tokens=False).ids
        a = tok.encode(r.response, add_special_tokens=False).ids + [end]
        out[r.id] = ((p + a)[:100], ([-100] * len(p) + a)[:100], len(p + a) > 100)
    return out, end


def test_sft_vocabulary(spark, plain):
    got = {r.id: (r.input_ids, r.labels, r.exceeding_length) for r in queries.sft_vocabulary(spark, SF).collect()}
    assert got == plain[0] and len({x[2] for x in got.values()}) == 2


def test_collate_vocabulary(spark, plain):
    rows, end = plain
    got = {r.id: r for r in queries.collate_vocabulary(spark, SF).collect()}
    longest = {}
    for k, (x, _, _) in rows.items():
        longest[k // 8] = max(longest.get(k // 8, 0), len(x))
    assert set(got) == set(rows)
    for k, (x, y, _) in rows.items():
        n = longest[k // 8] - len(x)
        assert (got[k].input_ids, got[k].labels) == (x + [end] * n, y + [-100] * n)
        assert got[k].attention_mask == [i == 0 or v != end for i, v in enumerate(x + [end] * n)]


def test_judge_vocabulary(spark):
    """The cap, in the vocabulary's tokens of examples and code, and the answers of the stand-in."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    spans = stages.T.split_docstring(F.col("content"))
    ask = prompts.judge_prompt(list(queries._JUDGED), spans["doc"], spans["code"], 5, F.col("doc_id"))
    dummy = stages.T.split_docstring(F.lit(prompts.DUMMY))
    bare = prompts.judge_prompt(list(queries._JUDGED), dummy["doc"], dummy["code"], 5, F.col("doc_id"))
    want = set()
    for r in queries.code(spark, SF).withColumns({"p": ask, "d": bare}).collect():
        fits = count(r.content) + count(r.d) - count(prompts.DUMMY) <= 240
        if r.p is not None and fits and services.stand_in_judge([r.p], services.Sampling()) == ["Yes"]:
            want.add(r.doc_id)
    assert {r.doc_id for r in queries.judge_vocabulary(spark, SF).collect()} == want and want
    assert len(want) < len([r for r in queries.code(spark, SF).withColumn("p", ask).collect() if r.p is not None and services.stand_in_judge([r.p], services.Sampling()) == ["Yes"]])


def test_tokens_of_odd_texts(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",), ("é" * 1000,), (None,)], "t string").repartition(1)
    tokenizer = queries.vocabulary()
    got = df.select(tokenizer.encode(F.col("t")).alias("x"), tokenizer.count(F.col("t")).alias("n"), tokenizer.decode(tokenizer.encode(F.col("t"))).alias("back"), "t").collect()
    assert all(r.back == r.t and r.n == (None if r.t is None else len(r.x)) for r in got)


# Near dedup by one shingling, and decontamination by blocks in turn.


def test_signatures_of_saved_sets(spark):
    sets = spark.createDataFrame([(1, [5, -7, 2**62]), (2, [2**62, 5, -7, 5]), (3, [])], "id long, s array<long>")
    got = {r.id: r.sig for r in dedup.set_signatures(sets, 8).collect()}
    up = lambda x: (x & (2**64 - 1)) >> 33
    assert got == {k: [min((up(x) * a + b) % dedup.PRIME for x in (5, -7, 2**62)) for a, b in dedup.coefficients(8)] for k in (1, 2)}


def test_strings_that_begin_alike(spark):
    """Hundreds of strings with one head, or one head and tail: all are found, and few are compared at a hit."""
    head, tail = "def solution(values): " * 4, " return the same result at the end" * 3
    bench = [head + f"case {k}" for k in range(300)] + [head + f"middle part number {k} of this very text" + tail for k in range(300)] + ["short", head]
    rng = random.Random(4)
    texts = [f"x{rng.choice(bench)}y {rng.choice(bench)[1:]}" for _ in range(200)] + [head[:-1], "shor", bench[5][1:]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, content string").repartition(2)
    pairs = decontam.contaminated_pairs(df, spark.createDataFrame([(b,) for b in bench], "text string"))
    want = {(k, b) for k, t in enumerate(texts) for b in bench if b in t}
    assert {(r.id, r.bench_text) for r in pairs.collect()} == want and pairs.count() == len(want)
    assert max(len(numbers) for _, numbers in decontam._automaton(bench).values()) <= 2


def test_blocks_of_a_benchmark_take_turns(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(3))
    bench = [" ".join(word() for _ in range(3)) for _ in range(400)] + ["", None]
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(300)] + [bench[0], None, "", "x" + bench[1] + "y"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, content string").repartition(3)
    table = spark.createDataFrame([(b,) for b in bench], "text string")
    want = [k for k, t in enumerate(texts) if not any(b and t and b in t for b in bench)]
    for size in (decontam.BLOCK_BYTES, 100):
        out = decontam.decontaminate(rows, table, block_bytes=size)
        assert ids(out) == want
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert len(re.findall("ArrowEvalPython", plan)) == 1


def test_large_bands_are_joined_exactly(spark, monkeypatch):
    """Texts that all share bands: the exact join on rare shingles gives the classes that comparing every pair gives."""
    rng = random.Random(8)
    common = [f"c{k}" for k in range(40)]
    rows = []
    for family in range(12):
        own = [f"f{family}x{k}" for k in range(30)]
        for _ in range(6):
            words = common + own
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(40, 70)] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    joined = []
    exact = dedup.similar_sets
    monkeypatch.setattr(dedup, "similar_sets", lambda *a: joined.append(1) or exact(*a))
    # One row a band: everything meets everything.
    one, other = ({r.id: r.component for r in dedup.near(df, "text", "id", 0.6, bands=40, rows_per_band=1, hot=hot).collect()} for hot in (1000, 3))
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    root = dict(zip(sets, sets, strict=True))
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert joined == [1]
    assert one == root and 12 <= len(set(root.values())) < 40
    assert other == root


def test_prompt_files_need_one_mark(spark):
    from pyspark.errors import PySparkException

    from seedmill.operators import decontam

    texts = ["a\nSOLUTION START\nb", "c\nBEGIN SOLUTION\nd", "e BEGIN SOLUTION\nSOLUTION START", None, "SOLUTION START", "none", "SOLUTION START SOLUTION START", "BEGIN SOLUTION\nBEGIN SOLUTION"]
    df = spark.createDataFrame([(t, k) for k, t in enumerate(texts)], "text string, name int")
    assert sorted(r.text for r in decontam.prompt_files(df.filter("name < 5")).collect()) == ["a\n", "c\n", "e BEGIN SOLUTION\n"]
    assert sorted(r.text for r in decontam.prompt_files(df, strict=False).collect()) == ["a\n", "c\n", "e BEGIN SOLUTION\n"]
    for bad in (5, 6, 7):
        with pytest.raises(PySparkException, match="without one mark"):
            decontam.prompt_files(df.filter(f"name = {bad}")).collect()


def test_encodings_of_a_batch_are_not_held_together(monkeypatch):
    """A batch of long texts is encoded a piece at a time, in order, by one tokenizer for each process."""
    import pandas as pd

    from seedmill import queries
    from seedmill.functions import tokens as K

    vocabulary, sizes = queries.vocabulary(), []
    plain = vocabulary.load()

    class Watched:
        def encode_batch_fast(self, texts, **how):
            sizes.append(sum(map(len, texts)))
            return plain.encode_batch_fast(texts, **how)

    texts = [f"def f_{k}(x): return {k}\n" * 50 if k % 7 else None for k in range(1_000)] + ["", "long " * K.PIECE]
    want = [None if t is None else plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert vocabulary.load() is vocabulary.load()
    monkeypatch.setattr(K, "_loaded", lambda path: Watched())
    assert [None if e is None else e.ids for e in vocabulary._encodings(pd.Series(texts, dtype=object))] == want
    assert len(sizes) > 3 and max(sizes[:-1]) <= K.PIECE
