"""Extraction by offsets, scope analysis, type checks by a program, import inference, and counters of a run."""

import ast
import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from seedmill.backends import name_check, services
from seedmill.functions import scopes, syntax
from seedmill.operators import imports, joins, sanitize
from seedmill.operators.counted import Report
from seedmill.operators.saved import saved, spread
from seedmill.plans import stages

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

DOC = '"""Doc."""'


def texts(code):
    return syntax.documented_functions(code)


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_functions_keep_their_text_whatever_the_line_ends(end):
    one = end.join(["def f(x):", f"    {DOC}", "    return 'é\u2028\x0c\x1c\x85'  # last"])
    two = end.join(["async def g(x):", f"    {DOC}", "    return x"])
    code = end.join(["X = 'a\x0cb\u2029'", "\x0c", "@cache", one, "", "\x0c", two, ""])
    assert texts(code) == [one, two]
    for _, name, a, b, text in syntax.located_functions(code):
        assert code.encode()[a:b].decode() == text and text.split("(")[0].split()[-1] == name


def test_a_form_feed_inside_a_string_moves_nothing():
    assert texts(f'X = "a\x0cb"\ndef f(x):\n    {DOC}\n    return 1\n') == [f"def f(x):\n    {DOC}\n    return 1"]


@pytest.mark.parametrize("first", ['r"""Doc."""', '("""Doc.""")', '"""a""" """b"""', "'''Doc.'''", '""""""', "1", '"""a""".strip()', 'f"""Doc."""'])
def test_only_one_plain_docstring_counts(first):
    assert texts(f"def f(x):\n    {first}\n    return x") == []


def test_quotes_and_escapes_inside_a_docstring():
    for doc in ('""""q" and ""two"\\" x"""', '"""a\\\\"""', '"""\n\n"""'):
        assert len(texts(f"def f(x):\n    {doc}\n    return x")) == 1


def test_nested_indented_and_shifted_functions_are_not_top_level():
    assert texts(f"class A:\n    def f(x):\n        {DOC}\nif x:\n    def g(x):\n        {DOC}\n") == []
    assert texts("def (") == texts(None) == texts("x = '\x00'") == []


def test_functions_of_a_table(spark):
    df = spark.createDataFrame([(1, f"def f():\n    {DOC}\n    return 1", "p"), (2, None, "q"), (3, "def (", "r"), (4, "", None)], "id long, content string, name2 string")
    got = syntax.functions_of(df)
    assert got.columns == ["id", "name2", "position", "name", "first_byte", "last_byte", "content"]
    assert [(r.id, r.position, r.name) for r in got.collect()] == [(1, 0, "f")]
    assert syntax.functions_of(df.limit(0)).count() == 0


def undefined(code):
    return scopes.facts(textwrap.dedent(code))["undefined"]


def test_scopes():
    assert undefined("import a.b, c as d\nfrom e import f\nprint(a, d, f, b, c, e)") == ["b", "c", "e"]
    assert undefined("def f(x, *a, k=z, **q):\n    y = [i for i in x if (w := i)]\n    return y, a, k, q, w, f, i") == ["i", "z"]
    assert undefined("def f():\n    global made\n    made = 1\nprint(made)") == []
    assert undefined("def f():\n    x = 1\n    def g():\n        nonlocal x\n        x += y\n    return g") == ["y"]
    assert undefined("class A(Base):\n    size = 3\n    def f(self):\n        return size, __class__, __name__") == ["Base", "size"]
    assert undefined("try:\n    import numpy as np\nexcept ImportError as e:\n    np = e\nwith open(p) as h, q:\n    del h") == ["p", "q"]
    assert undefined("match v:\n    case {'a': [x, *rest], **more}: print(x, rest, more)\n    case K(): pass") == ["K", "v"]
    assert undefined("def g[T](x: T) -> list[U]:\n    y: int\n    return x\n@deco\ndef h(): ...") == ["U", "deco"]
    # Anything may come from a starred import.
    assert undefined("from m import *\nfoo()") == []
    assert scopes.facts("def (")["problems"] == [{"line": 1, "message": "Code does not compile"}] and scopes.facts(None)["problems"] == []


def misfits(code):
    return [p["line"] for p in scopes.facts(textwrap.dedent(code))["problems"]]


def test_calls_that_do_not_fit():
    code = """\
    def f(a, b=1, /, c=2, *, d, e=3): return a
    f(1, d=1)
    f(1, 2, 3, d=1, e=2)
    f(d=1)
    f(1)
    f(1, 2, 3, 4, d=1)
    f(1, a=1, d=1)
    f(1, 2, 3, c=4, d=1)
    f(*[1], d=1)
    f(1, **{})
    """
    assert misfits(code) == [4, 5, 6, 7, 8]
    assert misfits("def f(*a, **k): pass\nf(1, 2, x=3)\nf()") == []
    # Calls agree with what Python itself says when the code runs.
    space = {}
    exec(textwrap.dedent(code).splitlines()[0], space)
    for n, line in enumerate(textwrap.dedent(code).splitlines()[1:8], 2):
        try:
            exec(line, space)
            fits = True
        except TypeError:
            fits = False
        assert fits == (n not in misfits(code))


def test_calls_of_names_that_may_mean_something_else_are_not_judged():
    for other in ("f = g", "import f", "from m import f", "def f(x): pass", "class f: pass", "def h(f):\n    pass", "@wrap\ndef f(): pass"):
        code = f"g = wrap = print\ndef f(a): pass\n{other}\nf(1, 2)" if "wrap\n" not in other else f"wrap = print\n{other}\nf(1, 2)"
        assert misfits(code) == []


def test_where_imports_go():
    late = "from __future__ import annotations"
    for code, head in (("x = 1", 0), ('"""Doc é."""\nx', 13), (late, len(late)), (f'"""D"""\r\n{late}\r\nimport b\r\n', len(late) + 11), ("import b\n", 0), ("", 0)):
        assert scopes.facts(code)["head"] == head


def codes(spark):
    rows = [("x = 1",), ("x = y",), ("def f(a): return a\nf()\nf(1, 2)",), ("def (",), ("x = '''é\r\n\u2028'''",), ("x = 1",)]
    return spark.createDataFrame(rows, "content string").withColumn("sha1", F.sha1("content")).repartition(1)


def test_checks_by_a_program(spark):
    rows = codes(spark)
    for batch in (1, 2, 250):
        for checker in (services.ProcessChecker(batch=batch), services.ScopeChecker(batch=batch)):
            got = {r.sha1: (r.errors, r.status) for r in checker.apply(rows).collect()}
            assert sorted(e for e, s in got.values() if s == "ok") == [0, 0, 1, 1, 2] and len(got) == 5
    assert [r.content for r in joins.with_verdicts(rows, services.ProcessChecker().apply(rows.dropDuplicates(["sha1"]))).sort("content").collect()] == ["x = '''é\r\n\u2028'''", "x = 1", "x = 1"]


def test_a_batch_that_takes_too_long_is_dropped(spark):
    """The program sleeps only where it is given the file of one text; the other batches pass."""
    rows = codes(spark).dropDuplicates(["sha1"]).repartition(1).sortWithinPartitions("content")
    slow = rows.filter("content = 'x = 1'").first().sha1
    command = (sys.executable, "-c", f"import sys, time\ntime.sleep(60 if '{slow}.py' in sys.argv else 0)\nprint('0 errors')")
    verdicts = saved(services.ProcessChecker(batch=2, command=command, seconds=2.0).apply(rows))
    failed = verdicts.filter("errors is null").collect()
    assert {r.sha1 for r in failed} >= {slow} and len(failed) == 2 and all("took over" in r.status for r in failed)
    assert joins.with_verdicts(rows, verdicts).count() == 3
    # Without a verdict a row stays; a program that can't be run fails its batches.
    assert joins.with_verdicts(rows, verdicts.limit(0)).count() == 5
    assert services.ProcessChecker(command=("/no/such/program",)).apply(rows).filter("errors is null").count() == 5


def test_the_program_reports_what_the_parser_reads(tmp_path):
    good, bad = tmp_path / "a.py", tmp_path / "b.py"
    good.write_text("x = 1")
    bad.write_text("x = y\nz")
    assert services.parse_report(name_check.report([str(good), str(bad)])) == {str(bad): 2}


def test_imports_learned_and_added(spark):
    files = ["import numpy as np\nnp.x", "import numpy as np", "import numpy as np", "from collections import OrderedDict as O", "from collections import OrderedDict as O", "import once", "from a import f", "from b import f", "from c import f", "from d import f", "def (", None]
    index = imports.learn(spark.createDataFrame([(x,) for x in files], "content string").repartition(3))
    assert {(r.name, r.statement, r.n) for r in index.collect()} == {("np", "import numpy as np", 3), ("O", "from collections import OrderedDict as O", 2)}
    rows = [(1, "x = np.y(O)", "k"), (2, '"""Doc."""', "k"), (3, '"""Doc."""\r\nnp', None), (4, None, "k"), (5, "def (", "k"), (6, "unknown", "k"), (7, "from __future__ import annotations\nO", "k"), (8, "x = np.y(O)", "k")]
    df = spark.createDataFrame(rows, "id long, content string, statements string").repartition(3)
    got = imports.add(df, index)
    assert got.columns == df.columns
    found = {r.id: r.content for r in got.collect()}
    both = "from collections import OrderedDict as O\nimport numpy as np\n"
    want = {k: c for k, c, _ in rows} | {1: both + "\nx = np.y(O)", 8: both + "\nx = np.y(O)", 3: '"""Doc."""\r\nimport numpy as np\nnp', 7: "from __future__ import annotations\nfrom collections import OrderedDict as O\nO"}
    assert found == want and all(ast.parse(found[k]) for k in (1, 3, 7))
    assert imports.add(df, index.limit(0)).count() == len(rows) and imports.add(df.limit(0), index).count() == 0


def test_without_imports():
    code = "from __future__ import annotations\r\nfrom m import (\r\n    a,\r\n    b,\r\n)\r\nx = a\r\nimport c"
    assert syntax.without_imports(code) == "from __future__ import annotations\r\nx = a\r\n"
    assert syntax.without_imports("def (") is None and syntax.without_imports(None) is None and syntax.without_imports("x") == "x"


def test_precision_counts_wrong_statements(spark):
    learned = spark.createDataFrame([("from a import f",)] * 3 + [("import m",)] * 2, "content string")
    held = spark.createDataFrame([("from a import f\nf()",), ("from b import f\nf()",), ("import m\nm.x",), ("import m",), ("import m\nopen_name",)], "content string")
    got = {r.statement: (r.there, r.inferred, r.right) for r in imports.precision(held, imports.learn(learned)).collect()}
    assert got == {"from a import f": (1, 2, 1), "from b import f": (1, 0, 0), "import m": (2, 1, 1)}


def test_counts_of_a_run(spark):
    report = Report()
    df = spark.range(100).repartition(5)
    kept = report.filter(report.filter(df, "s", "odd", F.col("id") % 2 == 0), "s", "null or large", F.when(F.col("id") != 4, F.col("id") < 50))
    assert saved(report.count(kept, "s", small=F.col("id") < 10)).count() == 24
    assert report.counts() == [("s", "odd", 100, 50), ("s", "null or large", 50, 26), ("s", "small", 24, 4)]
    assert report.table(spark).columns == ["stage", "reason", "rows_in", "n"]


def test_stages_give_the_same_rows_with_a_report(spark):
    block = "```python\n{}\n```"
    rows = spark.createDataFrame([(k, f"do {k}", block.format(c)) for k, c in enumerate(["x = 1", "x = 1", "def (", "y = 2", "y = 3"])] + [(9, "none", "no code")], "id long, instruction string, response string").repartition(3)
    runs = services.Executor(run=lambda code: "2" not in code, at_once=1)
    report = Report()
    for cache in (None, rows.filter("id = 0")):
        a, b = (sorted(map(tuple, stages.execution_filter(rows, runs, cache, r).collect())) for r in (None, report))
        assert a == b and [x[0] for x in a] == [0, 1, 4]
    assert report.counts() == [("execute", "uncompilable", 6, 2), ("execute", "cached", 4, 0), ("execute", "active", 4, 4), ("execute", "failed", 4, 1), ("execute", "uncompilable", 6, 2), ("execute", "cached", 4, 2), ("execute", "active", 4, 2), ("execute", "failed", 2, 1)]
    flags = sanitize.Flags(no_tests=True)
    assert saved(sanitize.sanitize(rows, flags, report=report)).count() == sanitize.sanitize(rows, flags).count() == 0


def test_clean_by_names_takes_responses_without_a_block(spark):
    """The first block counts whatever its tag; a response without one, or whose block doesn't parse, goes."""
    rows = [(1, "i1", "```\ndef f(): pass\n```"), (2, "i2", "```python\ndef f(): return\n```"), (3, "c", "none"), (4, "d", "```python\ndef (\n```"), (5, "e", "```sh\nx = 1\n```\n```python\ndef f(): pass\n```"), (6, "i6", "```python\ndef g(): pass\n```")]
    df = spark.createDataFrame(rows, "id long, instruction string, response string")
    got = {r.id for r in stages.clean(df, by_names=True).collect()}
    assert len(got & {1, 2}) == 1 and got - {1, 2} == {5, 6}


def test_the_checker_program_loads_no_engine():
    """Each batch is a process of its own; one that loads Spark and pandas takes longer to start than to check."""
    said = subprocess.run([sys.executable, "-c", "import sys, seedmill.backends.name_check; print([m for m in ('pyspark', 'pandas') if m in sys.modules])"], capture_output=True, text=True, cwd=ROOT, check=True).stdout
    assert said.strip() == "[]"


def test_work_that_costs_more_than_its_bytes_is_spread(spark):
    rows = spark.range(100).withColumn("content", F.concat(F.lit("x = "), F.col("id"))).select("content").distinct()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spread(rows, "content").groupBy(F.spark_partition_id()).count().count() == n
