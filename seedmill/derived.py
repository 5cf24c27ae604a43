"""Code and responses derived from the prose tables, by SQL that Spark and DuckDB read alike.

Each row's variant depends on its id only, so what an operator must find is known for every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q3 = '"""'
FENCE = "```"

#: Code by doc_id % 12; {id} stands for the id.
CODE = (
    f"def plus_{{id}}(x):\n    {Q3}Return x plus {{id}}.\n\n    Any number.{Q3}\n    y = x + {{id}}\n    return y",
    f"def none_{{id}}():\n    {Q3}Doc {{id}}.{Q3}\n    return {{id}}",
    f"def quiet_{{id}}(x):\n    {Q3}Doc {{id}}.{Q3}\n    print(x)\n    return",
    "def single_{id}(x):\n    '''Doc {id}.'''\n    return x",
    "def bare_{id}(x):\n    return x + {id}",
    f"def later_{{id}}(x):\n    {Q3}Doc {{id}}.{Q3}\n    # TODO later\n    return x",
    f"import os\n\ndef paths_{{id}}(x):\n    {Q3}Doc {{id}}.{Q3}\n    return os.path.join(x, x)",
    f"def trace_{{id}}(x):\n    {Q3}Doc {{id}}.{Q3}\n    debugger = x\n    return debugger",
    f"def long_{{id}}(x):\n    {Q3}Doc {{id}}.{Q3}\n{{many}}    return x",
    "def broken_{id}(x:\n    return x",
    f"def same(x):\n    {Q3}Doc.{Q3}\n    return x{{pad}}",
    f"@cache\ndef outer_{{id}}(x):\n    {Q3}Doc {{id}}.{Q3}\n    def inner(y):\n        return y\n    return inner(x)\n\nasync def second_{{id}}(x):\n    {Q3}More.{Q3}\n    return x",
)

#: Modules by doc_id % 14, for what depends on places and scopes: imports, unbound names, misfit calls, line ends of all kinds.
MODULES = (
    f"import math\n\ndef area_{{id}}(r):\n    {Q3}Area.{Q3}\n    return math.pi * r",
    "from collections import Counter\n\ndef count_{id}(xs):\n    return Counter(xs)",
    "def shift_{id}(x):\n    return x + offset_{id}",
    "def pair_{id}(a, b):\n    return a + b\n\nprint(pair_{id}(1))",
    "def tally_{id}(xs):\n    return Counter(xs)",
    f"def root_{{id}}(x):\n    {Q3}Root.{Q3}\n    return math.sqrt(x)",
    f"X = {{id}}\n\x0c\ndef feed_{{id}}(x):\n    {Q3}Feed.{Q3}\n    return x\n\x0c\ndef next_{{id}}(x):\n    {Q3}Next.{Q3}\n    return x\n",
    f"import os\r\n\r\ndef crlf_{{id}}(x):\r\n    {Q3}Doc.{Q3}\r\n    return os.sep + x\r\n",
    f"LINE = 'a\u2028b'\ndef wide_{{id}}(x):\n    {Q3}Doc é\x0b{{id}}.{Q3}\n    return LINE + x",
    f"def cr_{{id}}(x):\r    {Q3}Doc.{Q3}\r    return x\r\rdef cs_{{id}}(x):\r    {Q3}Doc.{Q3}\r    return cr_{{id}}(x, x)",
    "from __future__ import annotations\n\ndef late_{id}(x):\n    return math.floor(Counter(x))",
    "def broken_{id}(:\n",
    "from typing import Counter\n\ndef typed_{id}(xs):\n    return Counter(xs)",
    "from collections import Counter, deque\n\ndef both_{id}(xs):\n    return deque(Counter(xs))",
)

#: Responses by doc_id % 13.
_GOOD = "[Reasoning]\nThink {id}.\n\n[Implementation]\n{f}python\n# add\ndef f(x):\n    # one\n    return x + {id}\n{f}\n\n[Explanation]\nIt adds {id}.\n\n[Tests]\n"
RESPONSES = (
    _GOOD + "{f}python\nassert f(1) == {id}\nassert f(2) == 3\n{f}",
    _GOOD + "{f}python\ndef test_f():\n    assert f(1)\ntest_f()\n{f}",
    _GOOD + "{f}python\ndef test_f():\n    assert f(1)\n{f}",
    _GOOD + "{f}python\nassert f(1)\n{f}\n{f}python\nassert f(2)\n{f}",
    "[Implementation]\n{f}python\nx = {id}\n{f}\n[Reasoning]\nNo.\n[Explanation]\nNo.\n[Tests]\n{f}python\nassert x\n{f}",
    _GOOD + "{f}python\nassert f(1)\n{f}\n[Tests]\nagain",
    "[Reasoning]\nThink.\n[Implementation]\n{f}python\n# Your code here\n{f}\n[Explanation]\nNone {id}.\n[Tests]\n{f}python\nassert True\n{f}",
    "No sections {id}, only {f}PYTHON\nprint({id})\n{f} and {f}sh\nls\n{f}",
    _GOOD + "No block {id}.",
    "[Reasoning]\nThink.\n[Implementation]\nwords\n[Explanation]\nNone {id}.\n[Tests]\n{f}python\nassert True\n{f}",
    _GOOD + "{f}python\nassert f(3)\n{f}\n\nThese tests cover it.",
    _GOOD + "{f}python\nprint(f(1))\n{f}\n\nWe assert nothing.",
    _GOOD + "{f}python\nassert f(4)\n/ note\n{f}",
)


def _sql(template: str, key: str) -> str:
    """A template as a concatenation of plain literals."""
    holes = {"{id}": f"CAST({key} AS STRING)", "{many}": "repeat('    x = x' || chr(10), 150)", "{pad}": f"repeat(' ', CAST({key} % 5 AS INT))", "\n": "chr(10)", "\r": "chr(13)", "'": "chr(39)"}
    parts, at, plain = [], 0, ""
    while at < len(template):
        for hole, sql in holes.items():
            if template.startswith(hole, at):
                if plain:
                    parts.append(f"'{plain}'")
                parts.append(sql)
                plain, at = "", at + len(hole)
                break
        else:
            plain += template[at]
            at += 1
    return " || ".join([*parts, *([f"'{plain}'"] if plain else [])])


def case(templates: dict[int, str] | tuple[str, ...], key: str = "doc_id", n: int | None = None) -> str:
    """An expression that gives each row the template of its variant (null if there is none)."""
    found = templates if isinstance(templates, dict) else dict(enumerate(templates))
    return f"CASE {key} % {n or len(templates)} " + " ".join(f"WHEN {k} THEN {_sql(t.replace('{f}', FENCE), key)}" for k, t in found.items()) + " END"


CODE_SQL = case(CODE)
MODULE_SQL = case(MODULES)
RESPONSE_SQL = case(RESPONSES)
INSTRUCTION_SQL = "'Write item ' || CAST(doc_id % 97 AS STRING) || CASE WHEN doc_id % 4 = 0 THEN ' with a test' ELSE '' END"

#: Common table expressions for DuckDB.
CODE_CTE = f"code AS (SELECT doc_id, {CODE_SQL} AS content FROM documents)"
MODULE_CTE = f"modules AS (SELECT doc_id, {MODULE_SQL} AS content FROM documents)"
RESPONSE_CTE = f"resp AS (SELECT doc_id AS id, {INSTRUCTION_SQL} AS instruction, {RESPONSE_SQL} AS response FROM documents)"


def _once(expression: str) -> Column:
    """A column that Spark computes once for each row (nothing nondeterministic is inlined where it is used, and these texts are long expressions)."""
    return F.when(F.spark_partition_id() >= 0, F.expr(expression))


def code(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", _once(CODE_SQL).alias("content"))


def modules(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", _once(MODULE_SQL).alias("content"))


def responses(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("id"), F.expr(INSTRUCTION_SQL).alias("instruction"), _once(RESPONSE_SQL).alias("response"))
