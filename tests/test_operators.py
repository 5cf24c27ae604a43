"""Operators, stages and backends."""

import random

import pytest
from pyspark.sql import functions as F

from seedmill.backends import services
from seedmill.functions import prompts, syntax
from seedmill.functions import text as T
from seedmill.functions import tokens as K
from seedmill.operators import decontam, dedup, joins, position, sanitize
from seedmill.operators.graph import components
from seedmill.plans import stages
from seedmill.sources import files
from seedmill.streaming import resumable


def greedy(rows):
    seen, kept = set(), []
    for k, keys in rows:
        if not seen & set(keys):
            seen |= set(keys)
            kept.append(k)
    return kept


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_greedy_equals_a_sequential_pass(spark, parts):
    rng = random.Random(parts)
    rows = [(k, rng.randrange(9), rng.randrange(9), rng.randrange(9)) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, a long, b long, c long").repartition(parts)
    got = dedup.greedy(df, [F.col(c).cast("string") for c in "abc"], [F.col("id")], "id")
    assert sorted(r.id for r in got.collect()) == greedy([(r[0], list(map(str, r[1:]))) for r in rows])


def test_greedy_chain_and_empty(spark):
    df = spark.createDataFrame([(1, "x", "y"), (2, "y", "z"), (3, "z", "w"), (4, None, "q")], "id long, a string, b string")
    keys = [F.col("a"), F.col("b")]
    assert sorted(r.id for r in dedup.greedy(df, keys, [F.col("id")], "id").collect()) == [1, 3]
    assert dedup.greedy(df.limit(0), keys, [F.col("id")], "id").count() == 0


def test_near_dedup(spark):
    words = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:50], "x", *words[51:]])), (3, " ".join(reversed(words))), (4, " ".join(words)), (5, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.component for r in dedup.near(df, "text", "id", bands=16, rows_per_band=2).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_positions_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(f"s{k * 7 % 50:02d}",) for k in range(50)], "s string")
    for parts in (1, 4, 17):
        got = position.with_pos(df.repartition(parts), "s").orderBy("pos").collect()
        assert [(r.s, r.pos) for r in got] == [(f"s{k:02d}", k) for k in range(50)]
    pos = position.with_pos(df, "s")
    assert position.take(pos, 60, 5).count() == 0 and position.take(pos, 48, 5).count() == 2


def test_resume(spark):
    rows = spark.createDataFrame([(k, f"s{k}") for k in range(5)], "pos long, seed string")
    done = spark.createDataFrame([(0, "s0"), (1, "s2")], "out_pos long, seed string")
    assert sorted(r.seed for r in position.resume(rows, done).collect()) == ["s1", "s3", "s4"]
    assert sorted(r.seed for r in position.resume(rows, done, legacy=True).collect()) == ["s3", "s4"]


def test_decontaminate_in_blocks(spark):
    rows = spark.createDataFrame([(1, "say hello world"), (2, "Hello"), (3, None)], "id long, content string")
    bench = spark.createDataFrame([("hello",), ("",), ("nothing",)], "text string")
    for size in (1 << 20, 6):
        assert sorted(r.id for r in decontam.decontaminate(rows, bench, block_bytes=size).collect()) == [2, 3]
    plan = decontam.decontaminate(rows, bench)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("Scan") == 1


def test_strings_held_by_texts(spark):
    """Every string that a text holds, against plain search; strings that share heads, overlap or lie inside of others."""
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("aé b\n") for _ in range(n))
    texts = [make(rng.randint(0, 150)) for _ in range(60)]
    strings = sorted({t[a : a + rng.randint(1, 90)] for t in texts for a in (0, 3) if t[a:]} | {make(5) for _ in range(20)})
    rows = spark.createDataFrame([*enumerate(texts), (99, None)], "id long, content string")
    bench = spark.createDataFrame([(s, k) for k, s in enumerate([*strings, ""])], "text string, item long")
    for size in (1 << 20, 500):
        got = {(r.id, r.bench_item) for r in decontam.contaminated_pairs(rows, bench, block_bytes=size).collect()}
        assert got == {(k, i) for k, t in enumerate(texts) for i, s in enumerate(strings) if s in t}
        left = {r.id for r in decontam.decontaminate(rows, bench, block_bytes=size).collect()}
        assert left == {99} | {k for k, t in enumerate(texts) if not any(s in t for s in strings)}


def test_near_dedup_recall(spark):
    """At the threshold of 0.5: classes against the exact join; a large group of near copies makes few pairs."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    rows, k = [], 0
    for _ in range(60):
        base = rng.choices(words, k=60)
        for _ in range(rng.randint(1, 5)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(60)] = rng.choice(words)
            rows.append((k, " ".join(t)))
            k += 1
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    exact = dedup.similar_pairs(df, "text", "id", 0.5, 5)
    least = {t: i for i, t in reversed(rows)}
    plain = {i: {" ".join(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t, i in least.items()}
    want = {(a, b) for a in plain for b in plain if a < b and len(plain[a] & plain[b]) >= 0.5 * len(plain[a] | plain[b])}
    assert {(r.a, r.b) for r in exact.collect()} == want and len(want) > 50
    got = {r.id: r.component for r in dedup.near(df, "text", "id", 0.5).collect()}
    linked = sum(got[a] == got[b] for a, b in want)
    assert linked / len(want) >= 0.95
    assert all(got[i] == got[least[t]] for i, t in rows)
    roots = {r.node: r.root for r in components(exact.select("a", "b")).collect()}
    assert all(roots.get(i, i) == roots.get(got[i], got[i]) for i in plain)
    assert dedup.banding(0.8)[1] > dedup.banding(0.5)[1] >= 2
    group = spark.createDataFrame([(k, " ".join([*words[:200], f"end{k}"])) for k in range(300)], "id long, text string")
    held = dedup.banded(dedup.signatures(group, "text", "id"), "id", 8, 4)
    assert dedup.candidates(held).count() < 300 * 8 and {r.component for r in dedup.near(group, "text", "id").collect()} == {0}


def test_parse_is_done_once(spark):
    df = spark.createDataFrame([("def f(x): return x",)], "content string").withColumn("f", syntax.code_features(F.col("content"))).filter("f.has_return and f.parses").select("f.function_names")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("BatchEvalPython") == 1


def test_scan_reads_few_columns(spark):
    from seedmill import queries

    plan = queries.QUERIES["exact_dedup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_extraction_edges():
    decorated = '@cache\ndef f(x):\n    """Doc."""\n    return x\n'
    assert syntax.documented_functions(decorated) == ['def f(x):\n    """Doc."""\n    return x']
    for code in ("def f(:", 'def f(x):\n    r"""Doc."""\n    return x', 'def f(x):\n    """"""\n', "", None, 'class A:\n    def f(x):\n        """Doc."""\n'):
        assert syntax.documented_functions(code) == []


def test_functions_stage(spark):
    code = 'def f(x):\n    """Doc."""\n    return x'
    df = spark.createDataFrame([(code,), (code + "\n",), ("x = 1",), (None,)], "content string")
    assert [tuple(r) for r in stages.extract(df).collect()] == [(code, 0)]
    assert stages.typed(stages.extract(df)).count() == 1


def test_flags_are_checked():
    with pytest.raises(ValueError):
        sanitize.Flags(augmentation=0.5)
    with pytest.raises(ValueError):
        sanitize.Flags(raw=True, no_tests=True)


def test_supervised_and_padding(spark):
    df = spark.createDataFrame([([5, 6], [7]), ([], []), ([1, 2, 3, 4], [5, 6])], "p array<int>, r array<int>")
    got = [r.e for r in df.select(K.supervised(F.col("p"), F.col("r"), 5).alias("e")).collect()]
    assert (got[0].input_ids, got[0].labels, got[0].exceeding_length) == ([1, 5, 6, 7, 2], [-100, -100, -100, 7, 2], False)
    assert got[1].input_ids == [1, 2] and got[2].exceeding_length and len(got[2].labels) == 5
    batch = spark.createDataFrame([(0, [0, 3], [1, 2]), (0, [4, 5, 6], [1, 2, 3])], "b int, input_ids array<int>, labels array<int>")
    rows = K.collate(batch, "b", 0).collect()
    assert {len(r.input_ids) for r in rows} == {3} and sorted(r.attention_mask for r in rows)[0] == [True, True, False]


def test_fewshots():
    body = "".join(f"\n### Example {k}\n[Code]\nc\n[Property]\ncategory: a\nlanguage: b\nconcepts: x, y\ndifficulty: easy\n[Instruction]\ni\n[Solution]\n{'s' if k else ''}\n[Response]\nr\n" for k in range(2))
    few = prompts.parse_fewshots("### System: I->R\nA\n### System: C->I\nB\n### System: S->C\nC\n" + body)
    assert few.systems == {"I->R": "A", "C->I": "B", "S->C": "C"} and len(few.valid("I->R")) == 1 and few.examples[0].concepts == ("x", "y")


def test_generation_modes(spark):
    few = prompts.Fewshots({"I->R": "R", "C->I": "I", "S->C": "C"}, (prompts.Example("c", "l", ("a",), "easy", "s", "i", "x", "r"),))
    rows = spark.createDataFrame([(k, f"code {k}") for k in range(6)], "pos long, seed string")
    concepts = stages.generate(rows, "S->C", few, services.Completions(), 1)
    assert all(len(r.concepts) == 2 for r in concepts.collect())
    instructions = stages.generate(concepts, "C->I", few, services.Completions(), 1)
    many = stages.generate(instructions, "I->R", few, services.Completions(sampling=services.Sampling(n=3)), 1)
    assert "parsing_result" in many.columns and many.count() > 0

    def broken(prompt, seed, sampling):
        raise RuntimeError("down")

    assert stages.generate(rows, "S->C", few, services.Completions(broken, retry=services.Retry(1)), 1).count() == 0


def test_execution(spark):
    good, bad, early, hangs = "def f(n):\n    return f(n - 1) if n else 1\nassert f(3)", "assert False", "import sys\nsys.exit(0)", "while True: pass"
    assert [services.run_code(c, services.Limits(seconds=1.0)) for c in (good, bad, early, hangs)] == [True, False, False, False]
    rows = spark.createDataFrame([(k, f"```python\n{c}\n```\n") for k, c in enumerate((good, bad))], "id long, response string")
    assert [r.id for r in stages.execution_filter(rows, services.Executor()).collect()] == [0]
    cache = spark.createDataFrame([(f"```python\n{bad}\n```\n",)], "response string")
    assert sorted(r.id for r in stages.execution_filter(rows, services.Executor(), cache).collect()) == [0, 1]


def test_reports_and_imports():
    report = "/a/x.py\n  /a/x.py:1:1 - error: bad\n  /a/x.py:2:1 - warning: hm\n/a/y.py\n  - error: no\n1 error"
    assert services.parse_report(report) == {"/a/x.py": 1, "/a/y.py": 1}
    assert services.parse_report("  - error: before any file\nsummary") == {}
    assert services.add_imports("x = math.pi").startswith("import math\n") and services.add_imports("def (") == "def ("


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "a long, b string")
    files.write_jsonl(df, str(tmp_path / "j"))
    lines = spark.read.text(str(tmp_path / "j"))
    assert joins.common_keys(lines) == ["a", "b"]
    assert files.read_jsonl(spark, str(tmp_path / "j"), "a long, b string").count() == 2
    (tmp_path / "blank.json").write_text('{"a": 1}\n\n{"a": 2}\n')
    with pytest.raises(Exception, match="blank line"):
        files.read_jsonl(spark, str(tmp_path / "blank.json"), "a long").count()
    (tmp_path / "bad.json").write_text('{"a": 1}\n{"a": \n')
    for strict in (True, False):
        with pytest.raises(Exception, match="(?i)malformed"):
            files.read_jsonl(spark, str(tmp_path / "bad.json"), "a long", strict).collect()
    assert files.read_jsonl(spark, str(tmp_path / "blank.json"), "a long", strict=False).count() == 2
    assert [r.pos for r in files.read_jsonl_with_pos(spark, str(tmp_path / "j"), "a long").orderBy("pos").collect()] == [0, 1]


def test_stream_resumes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"a": 1}\n')
    args = (spark, str(tmp_path / "in"), "a long", lambda df: df.withColumn("b", F.col("a") + 1), str(tmp_path / "out"), str(tmp_path / "cp"))
    resumable.run(*args).awaitTermination()
    (tmp_path / "in" / "b.json").write_text('{"a": 5}\n')
    resumable.run(*args).awaitTermination()
    assert sorted(r.b for r in spark.read.json(str(tmp_path / "out")).collect()) == [2, 6]


def test_chat_rejects_system_turns(spark):
    df = spark.createDataFrame([([("user", "hi"), ("assistant", "yo")],), ([("system", "x")],)], "t array<struct<role:string,text:string>>")
    a, b = (r.p for r in df.select(prompts.chat(F.col("t")).alias("p")).collect())
    assert a.endswith("### Instruction\nhi\n\n### Response\nyo<|endoftext|>\n\n### Response\n") and b is None


def test_assertion_block_draws_one_to_five_lines(spark):
    """The MD5-keyed draw of assertion lines against a plain version, and blocks that are not all assertions."""
    import hashlib

    number = lambda *of: int(hashlib.md5("|".join(map(str, (0, *of))).encode()).hexdigest()[:13], 16)
    rows = [(i, "\n".join(f"assert f({j}) == {i}" for j in range(1 + i % 9))) for i in range(90)] + [(90, "x = 1\nassert f(x)")]
    seen = set()
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: r.a for r in df.select("id", sanitize.assertion_block(F.col("t"), 0, F.col("id")).alias("a")).collect()}
    for i, t in rows[:-1]:
        lines = t.split("\n")
        k = min(number(i, "k") % 5 + 1, len(lines))
        order = sorted(range(len(lines)), key=lambda j: (number(i, "lines", j), j))
        assert (got[i].text, got[i].term) == ("\n".join(lines[j] for j in order[:k]), "assertions" if k > 1 else "assertion")
        seen.add(k)
    assert seen == {1, 2, 3, 4, 5} and (got[90].text, got[90].term) == (rows[-1][1], "test case")


def test_tests_are_cut_at_the_last_fence(spark):
    """Against plain string rules: prose after the tests goes, and does not count as an assertion; a slash ends the tests."""
    head = "[Reasoning]\nr\n[Implementation]\n```python\nx = 1\n```\n[Explanation]\ne\n[Tests]\n"
    tests = ["```python\nassert x\n```\n\nThese tests cover it.", "```python\nprint(x)\n```\nWe assert nothing.", "Note: assert\n```python\nprint(x)\n```", "```python\nassert x\n\t/no\n/ cut\n```", "/ first\n```python\nassert x\n```", "```python\r\nassert x\r\n/ cut\r\n```", "```python\ndef f():\n    assert x\n```"]
    df = spark.createDataFrame([(k, "do", head + t) for k, t in enumerate(tests)], "id long, instruction string, response string")
    got = {r.id: r.response for r in sanitize.sanitize(df).collect()}
    want = {}
    for k, t in enumerate(tests):
        block = t[t.index("```python") + 9 : t.rindex("```")].strip()
        cut = t[: t.rindex("```") + 3]
        at = next((i for i, x in enumerate(cut.splitlines()) if x.startswith("/")), None)
        cut = cut if at is None else "".join(cut.splitlines(keepends=True)[:at]).strip()
        if "assert" in cut and not all(x.startswith(("def", "class", "import", "from")) for x in block.splitlines() if x and x[0].isalpha()):
            want[k] = "\n\n".join(["r", "```python\nx = 1\n```", "e", cut])
    assert got == want and set(want) == {0, 2, 3, 5}


def test_tokenizer_backend(spark):
    """Ids, frames and padding by a real vocabulary, against the library; text through ids and back."""
    import public_tokenizers

    t = K.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"), eos="<|endoftext|>")
    library = t.load()
    rows = spark.createDataFrame([("add one", "def f(x): return x + 1"), ("é 日本", ""), (None, "x")], "instruction string, response string")
    ids = rows.select("response", t.encode(F.col("response")).alias("i"), t.decode(t.encode(F.col("response"))).alias("back")).collect()
    assert all(list(r.i) == library.encode(r.response).ids and r.back == r.response for r in ids)
    got = stages.training(rows.filter("instruction is not null"), 64, tokenizer=t).collect()
    for r, (a, b) in zip(got, [("add one", "def f(x): return x + 1"), ("é 日本", "")], strict=True):
        p = library.encode(f"{prompts.SYSTEM}\n\n### Instruction\n{a}\n\n### Response\n").ids
        full = p + library.encode(b).ids + [50256]
        assert (r.input_ids, r.labels, r.exceeding_length) == (full[:64], ([-100] * len(p) + full[len(p) :])[:64], len(full) > 64)
    assert t.pad_id == 50256 and K.Tokenizer(t.path).pad_id is None
    assert K.truncated(stages.training(rows, 4, tokenizer=t)).first().n == 3


def test_judge_skips_long_rows(spark):
    """Rows over the token cap are asked about the dummy and left out, whatever the answer; so are rows that hold the dummy."""

    def yes(texts, sampling):
        assert len(texts) <= 2 and sampling.temperature == 0 and sampling.max_tokens == 5
        return ["yes"] * len(texts)

    doc = 'def f(x):\n    """Doc."""\n    return x'
    rows = spark.createDataFrame([(0, doc), (1, doc + "\n# " + "x" * 500), (2, prompts.DUMMY), (3, "no docstring"), (4, None)], "id long, content string")
    got = stages.judged(rows, [("D.", "c", "Yes")], services.Batched(yes, batch=2), F.length, 500)
    assert [r.id for r in got.collect()] == [0] and got.columns == rows.columns


def test_import_fixer_gives_up_in_time(spark):
    def hangs(code):
        while True:
            pass

    assert services.ImportFixer(hangs, 0.2)._one("x = 1") == "x = 1" and services.ImportFixer()._one(None) is None
    typed = stages.typed(spark.createDataFrame([(0, "def f(x):\n    return math.sqrt(x)")], "id long, content string"))
    assert typed.first().content.startswith("import math\n")


def test_resuming_is_guarded(spark, tmp_path):
    out = str(tmp_path / "out")
    resumable.guard(spark, out, "abc12", 5)
    resumable.guard(spark, out, "abc12", 5)
    resumable.guard(spark, out, "other", 5, ignore_fingerprint=True)
    for fingerprint, start in (("other", 5), ("abc12", 6)):
        with pytest.raises(ValueError):
            resumable.guard(spark, out, fingerprint, start)
    files.write_chunk(spark.range(2), out, 0)
    assert spark.read.json(out).count() == 2


def test_small_helpers(spark, tmp_path):
    template = prompts.inferred_template(lambda turns: "<s>" + "".join(f"[{r}]{t}[/]" for r, t in turns))
    assert template == "<s>[user]{instruction}[/][assistant]{response}"
    row = spark.createDataFrame([("2024-05-06 07:08:09",)], "t string").select(T.timestamp(F.col("t").cast("timestamp")).alias("v")).first()
    assert row.v == "20240506_070809"
    files.write_after_cached(spark.range(2), spark.range(5, 7), str(tmp_path / "r"))
    files.write_after_cached(spark.range(1), spark.range(5, 6), str(tmp_path / "r"))
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "r")).collect()) == [0, 5]


def test_saved_tables_are_released(spark):
    from seedmill.operators import saved

    before = set(saved._OPEN)
    with pytest.raises(RuntimeError), saved.released():
        assert saved.saved(spark.range(3)).count() == 3 and len(saved._OPEN) == len(before) + 1
        raise RuntimeError
    assert set(saved._OPEN) == before


def test_signatures_are_made_where_rows_are(spark):
    """Neither shingles nor hashes are shuffled, and the values are those of the MD5 of each shingle."""
    from hashlib import md5

    rows = spark.createDataFrame([(1, "A b  c\nd e f"), (2, "x\ty Z"), (3, " \n"), (4, None)], "id long, text string")
    sigs = dedup.signatures(rows, "text", "id", 3)
    assert "Exchange" not in sigs._jdf.queryExecution().toString()
    want = {1: ["a b c d e", "b c d e f"], 2: ["x\ty z"]}
    least = lambda texts: [min((int(md5(t.encode()).hexdigest()[:7], 16) * a + b) % dedup.PRIME for t in texts) for a, b in dedup.coefficients(3)]
    assert {r.id: list(r.sig) for r in sigs.collect()} == {k: least(t) for k, t in want.items()}


def test_near_dedup_loses_no_link(spark):
    """Pairs right at the threshold, of which bands alone miss some; null texts are copies of each other."""
    rng = random.Random(4)
    rows = []
    for k in range(400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(49)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:20], f"v{k}", *base[21:]]))]
    df = spark.createDataFrame([*rows, (900, None), (901, None), (902, "")], "id long, text string").repartition(3)
    got = {r.id: r.component for r in dedup.near(df, "text", "id").collect()}
    assert got == {k: k - k % 2 for k in range(800)} | {900: 900, 901: 900, 902: 902}


@pytest.mark.parametrize(("often", "side"), [(3, 4), (dedup.OFTEN, dedup.SIDE)])
def test_pairs_of_families(spark, monkeypatch, often, side):
    """Families of near copies, short texts around common lines, junk: all pairs as by brute force; those of a family never meet one by one."""
    rng = random.Random(3)
    words, texts = [f"w{k}" for k in range(400)], ["", None, "a", "b a", "x" * 300 + " y z", "x" * 299 + "z y z"]
    for size, n in ((80, 150), (40, 20), (20, 20)):
        base = rng.choices(words, k=size)
        for _ in range(n):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(size)] = rng.choice(words)
            texts.append(" ".join(t))
    lines = [[f"l{i}x{k}" for k in range(10)] for i in range(3)]
    texts += [" ".join([*rng.choices(words[:30], k=rng.randint(0, 8)), *rng.choice(lines), *rng.choices(words[:30], k=rng.randint(0, 6))]) for _ in range(90)]
    texts += [" ".join(rng.choices(words[:3], k=rng.randint(1, 9))) for _ in range(30)]
    rng.shuffle(texts)
    least = {t: i for i, t in reversed(list(enumerate(texts))) if t}
    plain = {i: {" ".join(w[j : j + 3]) for j in range(max(len(w) - 2, 1))} for t, i in least.items() for w in [t.split()]}
    shared = {(a, b): len(plain[a] & plain[b]) / len(plain[a] | plain[b]) for a in plain for b in plain if a < b}
    want = {pair: s for pair, s in shared.items() if s >= 0.5}
    one_by_one, whole = [], dedup.paired
    monkeypatch.setattr(dedup, "paired", lambda pairs, *rest: (one_by_one.append(pairs.count()), whole(pairs, *rest))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    sets = dedup.hashed_shingles(dedup.distinct_texts(df, "text", "id")[1], "text", 3)
    got = dedup.similar_sets(sets, 0.5, often=often, side=side).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.similarity for r in got} == want
    assert len(want) > 6_000 and one_by_one[0] < 500
    classes = {i: rng.choice([i, 0, 1]) for i in plain}
    got = dedup.similar_sets(sets, 0.5, spark.createDataFrame(list(classes.items()), "id long, root long"), often, side).collect()
    assert {(r.a, r.b): r.similarity for r in got} == {(a, b): s for (a, b), s in want.items() if classes[a] != classes[b]}
    # Texts that go on in the next batch.
    held = {r.id: (r.n, list(r.o)) for r in dedup.shareable(sets, 0.5).collect()}
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {r.id: (r.n, list(r.o)) for r in dedup.shareable(sets, 0.5).collect()} == held
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
