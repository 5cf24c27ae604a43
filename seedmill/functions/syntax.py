"""Features of Python source, by Arrow UDFs around the standard parser; each row is parsed once."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .source import Source, parse

# Types as objects: UDFs are made at import, when there may be no session to read a type's text.
FEATURES = StructType([StructField(n, BooleanType()) for n in ("parses", "has_return", "first_statement_is_expr", "first_is_string")] + [StructField(n, StringType()) for n in ("first_text", "first_function", "function_names")])


#: One string in triple double quotes that holds something.
DOCSTRING = re.compile(r'"""(?:[^"\\]|\\.|"(?!""))+"""', re.S)

FUNCTION = StructType([StructField("position", IntegerType()), StructField("name", StringType()), StructField("first_byte", LongType()), StructField("last_byte", LongType()), StructField("content", StringType())])


def _function_names(tree: ast.Module) -> list[str]:
    """Names of all function definitions, nested ones after the one that holds them."""
    found: list[str] = []
    todo: list[ast.AST] = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            found.append(node.name)
        todo += reversed(list(ast.iter_child_nodes(node)))
    return found


def features(code: str | None) -> dict:
    out: dict = {"parses": False, "has_return": False, "first_statement_is_expr": None, "first_is_string": None, "first_text": None, "first_function": None, "function_names": None}
    tree = parse(code)
    if tree is None:
        return out
    functions = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    out |= {"parses": True, "function_names": " ".join(_function_names(tree)), "has_return": any(isinstance(n, ast.Return) and n.value is not None for n in ast.walk(tree))}
    if functions:
        first = min(functions, key=lambda f: (f.lineno, f.col_offset))
        body = first.body[0]
        is_expr = isinstance(body, ast.Expr)
        out |= {"first_function": first.name, "first_statement_is_expr": is_expr, "first_is_string": is_expr and isinstance(body.value, ast.Constant) and isinstance(body.value.value, str), "first_text": Source(code).segment(body.value if is_expr else body)}
    return out


@F.pandas_udf(FEATURES)
def _features(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([features(c) for c in code], columns=FEATURES.names)


@F.pandas_udf(ArrayType(StringType()))
def _documented(code: pd.Series) -> pd.Series:
    return code.map(documented_functions)


@F.pandas_udf(ArrayType(BooleanType()))
def _compiles(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda b: [parse(x) is not None for x in b] if b is not None else None)


def located_functions(code: str | None) -> Iterator[tuple[int, str, int, int, str]]:
    """FUNCTION of each top-level function whose body begins with one plain triple-double-quoted string that isn't empty.

    A function's text goes from its ``def`` (decorators lie before it) to the end of its last line.
    """
    tree = parse(code)
    if tree is None:
        return
    source, n = Source(code), 0
    for node in tree.body:
        if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef) or not isinstance(node.body[0], ast.Expr):
            continue
        first, value = node.body[0], node.body[0].value
        bare = isinstance(value, ast.Constant) and isinstance(value.value, str) and (first.lineno, first.col_offset) == (value.lineno, value.col_offset)
        if bare and DOCSTRING.fullmatch(source.segment(value)):
            a, b = source.starts[node.lineno - 1] + node.col_offset, source.stops[node.end_lineno - 1]
            yield n, node.name, a, b, source.between(a, b)
            n += 1


def documented_functions(code: str | None) -> list[str]:
    """The texts of located_functions."""
    return [content for *_, content in located_functions(code)]


def without_imports(code: str | None) -> str | None:
    """The text without the lines of its top-level import statements (but those of __future__); null where it doesn't parse."""
    tree = parse(code)
    if tree is None:
        return None
    source = Source(code)
    gone = [n for n in tree.body if isinstance(n, ast.Import) or isinstance(n, ast.ImportFrom) and n.module != "__future__"]
    edges = [*source.starts, len(source.raw)]
    out, at = [], 0
    for n in gone:
        out.append(source.between(at, edges[n.lineno - 1]))
        at = max(at, edges[n.end_lineno])
    return "".join([*out, source.between(at, len(source.raw))])


@F.udtf(returnType=FUNCTION, useArrow=True)
class _Located:
    """One row for each documented function of a text."""

    def eval(self, code: str):
        yield from located_functions(code)


def functions_of(files: DataFrame, content: str = "content") -> DataFrame:
    """files without their text, one row for each documented function: its position, name, byte offsets and text."""
    # The generated text takes the place of the file's.
    rest = [F.col(c) for c in files.columns if c != content]
    source = files.select(*rest, F.col(content).alias("_file"))
    return source.lateralJoin(_Located(F.col("_file").outer())).drop("_file")


def code_features(code: Column) -> Column:
    """FEATURES as a struct; marked nondeterministic so that a filter on it doesn't parse again."""
    return _features.asNondeterministic()(code)


def extract_functions(code: Column) -> Column:
    return _documented(code)


def compilable(blocks: Column) -> Column:
    """The blocks that compile."""
    flags = _compiles.asNondeterministic()(blocks)
    return F.transform(F.filter(F.arrays_zip(blocks.alias("b"), flags.alias("ok")), lambda x: x["ok"]), lambda x: x["b"])
