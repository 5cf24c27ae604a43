"""The chains: interrupted and repeated runs, several samples of a row, failed requests, empty tables."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from seedmill.backends.services import Batched, Checker, Completions, Executor, Retry, Sampling
from seedmill.functions import prompts
from seedmill.operators import sanitize
from seedmill.operators.counted import Report
from seedmill.plans import chains, stages
from seedmill.queries import _FEWSHOT_FILE
from seedmill.sources.commits import Table

FEWSHOTS = prompts.parse_fewshots(_FEWSHOT_FILE)
FENCE = "```"


def noted(folder, fails=()):
    """A model that notes its requests in a file of the folder and fails for some seeds while another file is there."""
    folder = str(folder)

    def model(prompt, seed, sampling):
        with open(f"{folder}/asked", "a") as f:
            f.write(f"{seed}\n")
        if seed in fails and os.path.exists(f"{folder}/down"):
            raise ValueError("down")
        return [("stop", f"a{seed}-{k}, b") for k in range(sampling.n)]

    return model


def asked(folder):
    return sorted(map(int, (folder / "asked").read_text().split()))


def seeds(spark, n):
    return spark.range(n).select(F.concat(F.lit("s"), F.format_string("%03d", "id")).alias("seed"))


def with_pos(spark, n):
    return spark.range(n).select(F.col("id").alias("pos"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("seed"))


def test_interrupted_mode_goes_on_where_it_stopped(spark, tmp_path):
    mode = chains.Mode("S->C", 2, Completions(noted(tmp_path), retry=Retry(1)))
    table, rows = Table(spark, str(tmp_path / "out")), with_pos(spark, 50)
    write, written = table.write, []

    def killed(rows, chunk=None, **more):
        if len(written) == 2:
            raise KeyboardInterrupt
        written.append(chunk)
        write(rows, chunk=chunk, **more)

    table.write = killed
    with pytest.raises(KeyboardInterrupt):
        chains.run_mode(rows, mode, FEWSHOTS, table, chunk=10, seed=0)
    assert written == [0, 1]
    before = len(asked(tmp_path))
    table = Table(spark, str(tmp_path / "out"))
    got = chains.run_mode(rows, mode, FEWSHOTS, table, chunk=10, seed=0)
    # The third chunk's requests were made before its write failed; those of committed chunks are not made again.
    assert before == 30 and len(asked(tmp_path)) == 30 + 30
    assert sorted((r.pos, r.concepts[0]) for r in got.collect()) == [(k, f"a{k}-0") for k in range(50)]
    chains.run_mode(rows, mode, FEWSHOTS, table, chunk=10, seed=0)
    assert len(asked(tmp_path)) == 60


def test_retry_asks_for_failed_rows_only(spark, tmp_path):
    (tmp_path / "down").touch()
    mode = chains.Mode("S->C", 2, Completions(noted(tmp_path, (3, 17)), retry=Retry(1)))
    table, rows = Table(spark, str(tmp_path / "out")), with_pos(spark, 20)
    got = chains.run_mode(rows, mode, FEWSHOTS, table, chunk=8, seed=0)
    assert sorted(r.pos for r in got.collect()) == [k for k in range(20) if k not in (3, 17)]
    (tmp_path / "down").unlink()
    assert chains.run_mode(rows, mode, FEWSHOTS, table, chunk=8, seed=0).count() == 18
    got = chains.run_mode(rows, mode, FEWSHOTS, table, chunk=8, seed=0, retry=True)
    assert sorted(r.pos for r in got.collect()) == list(range(20))
    assert len(asked(tmp_path)) == 22


def test_slices_and_chunks_give_the_same_rows(spark, tmp_path):
    mode = chains.Mode("S->C", 2, Completions())
    rows = with_pos(spark, 40)
    runs = {}
    for name, chunk in (("a", 7), ("b", 100)):
        got = chains.run_mode(rows, mode, FEWSHOTS, Table(spark, str(tmp_path / name)), chunk=chunk, start=5, n=30)
        runs[name] = sorted((r.pos, tuple(r.concepts), r.prompt, r.fingerprint) for r in got.collect())
    assert runs["a"] == runs["b"]
    assert {r[0] for r in runs["a"]} <= set(range(5, 35)) and len(runs["a"]) > 20
    assert {r[3] for r in runs["a"]} == {mode.fingerprint(FEWSHOTS, 3407)}


def test_another_run_may_not_go_on_with_a_table(spark, tmp_path):
    table, rows = Table(spark, str(tmp_path / "out")), with_pos(spark, 4)
    chains.run_mode(rows, chains.Mode("S->C", 2, Completions()), FEWSHOTS, table)
    with pytest.raises(ValueError, match="fingerprint"):
        chains.run_mode(rows, chains.Mode("S->C", 1, Completions()), FEWSHOTS, table)
    with pytest.raises(ValueError, match="begins at"):
        chains.run_mode(rows, chains.Mode("S->C", 2, Completions()), FEWSHOTS, table, start=1)


def test_instruct_runs_all_modes(spark, tmp_path):
    modes = [chains.Mode("S->C", 2, Completions()), chains.Mode("C->I", 1, Completions()), chains.Mode("I->R", 2, Completions(sampling=Sampling(n=3)))]
    got = chains.instruct(seeds(spark, 60), ["seed"], FEWSHOTS, modes, str(tmp_path), chunk=25).collect()
    assert 30 < len(got) < 60
    for r in got:
        assert r.seed == f"s{r.pos:03d}" and len(r.concepts) == 2 and ", ".join(r.concepts) not in r.prompt
        assert r.instruction in r.prompt and 1 <= len(r.parsing_result) <= 3
    assert sorted(p for p in os.listdir(tmp_path) if not p.startswith(".")) == ["C-to-I", "I-to-R", "S-to-C"]
    with pytest.raises(ValueError, match="differ"):
        chains.instruct(seeds(spark, 3).union(seeds(spark, 2)), ["seed"], FEWSHOTS, modes, str(tmp_path / "other"))
    assert chains.instruct(seeds(spark, 0), ["seed"], FEWSHOTS, modes, str(tmp_path / "none")).count() == 0


def response(n, passes=True):
    return f"[Reasoning]\nThink {n}.\n\n[Implementation]\n{FENCE}python\ndef f(x):\n    return x + {n}\n{FENCE}\n\n[Explanation]\nIt adds {n}.\n\n[Tests]\n{FENCE}python\nassert f(1) == {n}{'' if passes else '  # never'}\n{FENCE}"


def test_of_several_passing_samples_one_stays(spark):
    rows = [(1, "Add one", [response(1, False), response(2), response(3)]), (2, "Add two", [response(2), response(4)]), (3, "Add one", [response(5)]), (4, "None", [response(6, False)]), (5, "Empty", [])]
    df = spark.createDataFrame([(i, t, [{"response": x} for x in xs]) for i, t, xs in rows], "id long, instruction string, parsing_result array<struct<response:string>>")
    report = Report()
    got = chains.curate(df, Executor(run=lambda code: "never" not in code, at_once=1), flags=sanitize.Flags(no_tests=True), report=report).collect()
    by = {r.sample_id: r.response for r in got}
    assert len(by) == len(got) == 2
    # One of each instruction, and never the same response twice.
    assert {r.instruction for r in got} == {"Add one", "Add two"} and len(set(by.values())) == 2
    assert all("[Tests]" not in x and "assert" not in x for x in by.values())
    assert not {"1-0", "4-0"} & set(by)
    assert [c[1:] for c in report.counts() if c[:2] == ("execute", "failed")] == [("failed", 7, 2)]
    # What stays is what the greedy pass keeps over the samples in their drawn order.
    key = lambda s: (int(hashlib.md5(f"0|{s}".encode()).hexdigest()[:13], 16), s)
    seen, want = set(), set()
    for s, t, x in sorted(((f"{i}-{k}", t, x) for i, t, xs in rows for k, x in enumerate(xs) if "never" not in x), key=lambda r: key(r[0])):
        if not seen & {t, x}:
            want.add(s)
            seen |= {t, x}
    assert set(by) == want


def test_curate_takes_columns_of_its_own_names(spark):
    df = spark.createDataFrame([(1, "Add", response(1), 7, "old"), (None, "Sub", response(2), 8, "old"), (3, None, response(3), 9, "old"), (4, "Mul", None, 9, "old")], "id long, instruction string, response string, sample_idx int, sample_id string")
    got = chains.curate(df, Executor(run=lambda code: True, at_once=1), flags=sanitize.Flags(no_tests=True)).collect()
    # Without an id the sample's number alone is its name; without an instruction a row has no key to be cleaned by.
    assert sorted((r.sample_id, r.instruction) for r in got) == [("0", "Sub"), ("1-0", "Add")]


def test_curate_of_nothing(spark):
    df = spark.createDataFrame([], "id long, instruction string, response string, extra int")
    got = chains.curate(df, Executor(run=lambda code: True, at_once=1))
    assert got.count() == 0 and {"sample_id", "instruction", "response", "extra"} <= set(got.columns)


def test_evaluation_counts_failed_requests_as_failed_samples(spark):
    def model(prompt, seed, sampling):
        if seed == 2:
            raise ValueError("down")
        return [("stop", f"    return {seed}\n{FENCE}\nprose")]

    raw = spark.createDataFrame([("p", "def f():"), ("q", "def g():")], "name string, prompt string")
    problems = raw.select(stages.humaneval_problem(F.col("prompt"), F.col("name")).alias("p")).select("p.*").withColumn("tests", F.lit("assert True"))
    codes = lambda code: code in ("def f():    return 0\n\nassert True", "def f():    return 3\n\nassert True")
    got = {r.id: (r.n, r.c, round(r.pass_at_k, 6)) for r in chains.evaluate(problems, 5, 2, Completions(model, retry=Retry(1)), Executor(run=codes, at_once=1), seed=0, tests="tests").collect()}
    assert got == {"p": (5, 2, 0.7), "q": (5, 0, 0.0)}
    real = chains.evaluate(problems, 2, 1, Completions(lambda p, s, c: [("stop", f"\n    return {s}\n{FENCE}")]), Executor(at_once=2), tests="tests").collect()
    assert sorted((r.id, r.c) for r in real) == [("p", 2), ("q", 2)]
    assert chains.evaluate(problems.limit(0), 3, 1, Completions(), Executor(run=codes)).count() == 0


def test_gather_keeps_one_of_near_copies_and_infers_imports(spark):
    doc = '"""Sum the numbers of a list that are positive, in the order in which they come."""'
    body = "    total = 0\n    for number in numbers:\n        if number > 0:\n            total = total + number\n    return total"
    files = [f"def first(numbers):\n    {doc}\n{body}\n", f"def first(numbers):\n    {doc}\n{body}  # the total\n", f"import math\n\ndef root(x):\n    {doc}\n    return math.sqrt(x)\n\x0c\ndef lost(x):\n    {doc.replace(' ', '  of ')}\n    return nowhere(x)\n", "import math\n\nprint(math.pi)\n", None, ""]
    df = spark.createDataFrame([(f, k) for k, f in enumerate(files)], "text string, content int")
    bench = spark.createDataFrame([("none of these",)], "text string")
    how = chains.Gathering((("Adds.", "def add(x):\n    return x", "Yes"),), F.length, judge=Batched(lambda ps, s: ["Yes"] * len(ps)), most=10_000)
    got = sorted(r.content for r in chains.gather(df, bench, how, "text").collect())
    assert len(got) == 2
    assert got[0].startswith("def first(numbers):") and got[1] == f"import math\n\ndef root(x):\n    {doc}\n    return math.sqrt(x)"
    refused = chains.Gathering(how.examples, F.length, judge=Batched(lambda ps, s: ["No"] * len(ps)), checker=Checker())
    assert chains.gather(df, bench, refused, "text").count() == 0
    assert chains.gather(df.limit(0), bench, how, "text").count() == 0


def test_gather_equals_its_sql_at_long_ids(spark, tmp_path):
    """Ids of six digits make functions as long as the judge's limit allows, by the operator's measure of a prompt."""
    import duckdb

    from seedmill import queries

    ids = "SELECT i::BIGINT AS doc_id FROM (SELECT unnest(range(24)) AS i UNION ALL SELECT unnest(range(120000, 120096)))"
    duckdb.sql(f"COPY ({ids}) TO '{tmp_path}/documents.parquet'")
    duckdb.sql(f"COPY (SELECT 0::BIGINT AS item_id, 'nowhere to be found' AS text) TO '{tmp_path}/benchmark.parquet'")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = db.sql(queries.ORACLES["chain_gather"].rstrip()).fetchall()
    got = queries.QUERIES["chain_gather"](spark, str(tmp_path)).select("id", "sha1", "content").collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(len(c) == 100 for *_, c in want)
