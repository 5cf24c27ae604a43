"""Python source and its tree, by the standard library alone: checker programs, each a process of its own, load nothing else."""

from __future__ import annotations

import ast
import re
import warnings

#: Where the parser ends a line; form feeds and Unicode's separators are none.
LINE_END = re.compile(rb"\r\n|\n|\r")


class Source:
    """A text as UTF-8 with the byte at which each line starts, so that the parser's positions become byte offsets."""

    def __init__(self, code: str):
        self.raw = code.encode("utf-8", "surrogatepass")
        ends = list(LINE_END.finditer(self.raw))
        self.starts = [0, *(m.end() for m in ends)]
        #: Where each line's text ends, without its line end.
        self.stops = [*(m.start() for m in ends), len(self.raw)]

    def between(self, a: int, b: int) -> str:
        return self.raw[a:b].decode("utf-8", "surrogatepass")

    def segment(self, node: ast.AST) -> str:
        return self.between(self.starts[node.lineno - 1] + node.col_offset, self.starts[node.end_lineno - 1] + node.end_col_offset)


def parse(code: str | None) -> ast.Module | None:
    """The tree, or null for text that doesn't compile (or null)."""
    if code is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
