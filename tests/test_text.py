"""Text functions against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from seedmill.functions import text as T

SAMPLES = ["", " ", "a", " a b ", "a\x1cb\x85c\xa0", "\u2003x\u3000", "a\nb\n", "a\r\nb\rc", "x\x0by\x0cz\u2028w", "tail \n", "日本 語\n"]


def values(spark, texts, column):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.v for r in df.select("k", column(F.col("t")).alias("v")).orderBy("k").collect()]


def test_white_space(spark):
    assert values(spark, SAMPLES, T.strip) == [s.strip() for s in SAMPLES]
    assert values(spark, SAMPLES, T.rstrip) == [s.rstrip() for s in SAMPLES]
    assert values(spark, SAMPLES, T.ws_key) == ["".join(s.split()) for s in SAMPLES]


def test_splitlines(spark):
    assert values(spark, SAMPLES, T.splitlines) == [s.splitlines() for s in SAMPLES]


def test_places(spark):
    texts = ["aXbXc", "", "XX", "none"]
    assert values(spark, texts, lambda c: T.index(c, "X")) == [t.find("X") for t in texts]
    assert values(spark, texts, lambda c: T.rindex(c, "X")) == [t.rfind("X") for t in texts]
    assert values(spark, texts, lambda c: T.count_of(c, "X")) == [t.count("X") for t in texts]


def scan_blocks(text):
    """An independent scanner of fenced blocks."""
    out, at = [], 0
    while (a := text.find("```", at)) >= 0:
        line_end = text.find("\n", a + 3)
        tag = text[a + 3 : line_end].strip() if line_end >= 0 else ""
        start = line_end + 1 if tag and line_end >= 0 and "```" not in text[a + 3 : line_end] or (tag and line_end >= 0) else a + 3
        b = text.find("```", start)
        if b < 0:
            break
        out.append(text[start:b].strip())
        at = b + 3
    return out


def test_fenced_blocks(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["```", "python", "\n", " ", "x", "`"]) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    assert values(spark, texts, T.fenced_blocks) == [scan_blocks(t) for t in texts]


def test_fenced_tag(spark):
    text = "```Python\na\n``` ```sh\nb\n``` ```python\nc\n```"
    assert values(spark, [text], lambda c: T.fenced_blocks(c, "python")) == [["a", "c"]]


def test_exec_blocks(spark):
    text = "```python\na = 1\n```\n  ```python\nno\n```\n```Python\nno\n```"
    assert values(spark, [text], T.exec_blocks)[0][0] == "a = 1\n"


def test_unindent_and_docstring(spark):
    code = 'def f(x):\n    """First.\n\n    Second.\n    """\n    return x'
    got = values(spark, [code, "no docstring", '""""""'], T.split_docstring)
    assert got[0].doc == "First.\n\n    Second." and got[0].code == "def f(x):\n    \n    return x"
    assert got[1] is None and got[2] is None
    assert values(spark, ["  a\n\n    b"], T.unindent) == ["a\n\n  b"]


def test_benchmark_docstring(spark):
    texts = ['a """one""" b', '"""x""" y """two""" z', "'''three'''", '"""odd']
    assert values(spark, texts, T.benchmark_docstring) == ["one", "two", "three", None]


def test_cut_at(spark):
    assert values(spark, ["a SOLUTION START b", "a BEGIN SOLUTION b", "c"], lambda c: T.cut_at(c, "SOLUTION START", "BEGIN SOLUTION")) == ["a ", "a ", "c"]


def strip_comments(text):
    parts = text.split("```")
    for k in range(1, len(parts) - 1, 2):
        lines = parts[k].split("\n")
        comment = [x.lstrip().startswith("#") and i > 0 for i, x in enumerate(lines)]
        parts[k] = "\n".join(x for i, x in enumerate(lines) if not (comment[i] or (i > 1 and not x.strip() and i + 1 < len(lines) and comment[i + 1])))
    return "```".join(parts)


@pytest.mark.parametrize("text", ["# out\n```python\n# a\nx = 1  # tail\n\n# b\ny = '#'\n```\n# out", "```python\n\n# a\nx\n```", "no block # x", "```\n# a\n``` # b ```\nz"])
def test_comments(spark, text):
    assert values(spark, [text], T.without_comments) == [strip_comments(text)]


def test_properties(spark):
    text = "category: c: d\nlanguage: Python\nconcepts: a, b\ndifficulty: easy"
    p = values(spark, [text, "a: b"], T.properties)
    assert (p[0].category, p[0].concepts, p[1]) == ("c: d", ["a", "b"], None)
    assert values(spark, [text], lambda c: T.render_properties(T.properties(c))) == [text]


def test_bad_words_are_plain_substrings(spark):
    from seedmill.operators import filters

    texts = ["debug", "import ossaudiodev", "from sys import x", "Import OS", "fine"]
    assert values(spark, texts, filters.clean_words) == [False, False, False, False, True]
    assert values(spark, ["a\n" * 149 + "b", "a\n" * 150], filters.few_lines) == [True, False]
    assert values(spark, ["def f():\n", "async def f():\n", " def f():", "def f(x=()):"], filters.takes_arguments) == [bool(not re.search(r"(?m)^def [^\n]*\(\):", t)) for t in ["def f():\n", "async def f():\n", " def f():", "def f(x=()):"]]
