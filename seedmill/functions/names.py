"""Scopes and bindings of Python source: what a module imports, which names nothing binds, calls that don't fit a local function.

The standard library's symbol tables resolve scopes; a finding is made only where the source alone decides it.
"""

from __future__ import annotations

import ast
import builtins
import symtable
from collections.abc import Iterator

from .source import Source, parse

BUILTIN = frozenset(dir(builtins)) | {"__file__", "__builtins__", "__annotations__", "__path__"}


def _tables(top: symtable.SymbolTable) -> Iterator[symtable.SymbolTable]:
    todo = [top]
    while todo:
        table = todo.pop()
        yield table
        todo += table.get_children()


def imports(tree: ast.Module) -> list[tuple[str, str]]:
    """(bound name, statement that binds it alone) of all absolute imports."""
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(a.asname or a.name.split(".")[0], f"import {a.name}" + (f" as {a.asname}" if a.asname else "")) for a in node.names]
        elif isinstance(node, ast.ImportFrom) and not node.level and node.module != "__future__":
            out += [(a.asname or a.name, f"from {node.module} import {a.name}" + (f" as {a.asname}" if a.asname else "")) for a in node.names if a.name != "*"]
    return out


def _misfit(function: ast.FunctionDef | ast.AsyncFunctionDef, call: ast.Call) -> str | None:
    """Why a call can't bind to a function's parameters; null if it can or if starred arguments hide what it passes."""
    a = function.args
    if any(isinstance(x, ast.Starred) for x in call.args) or any(k.arg is None for k in call.keywords):
        return None
    places = [p.arg for p in a.posonlyargs + a.args]
    by_name = {p.arg for p in a.args + a.kwonlyargs}
    given = {k.arg for k in call.keywords}
    if len(call.args) > len(places) and not a.vararg:
        return f"Expected {len(places)} positional arguments"
    if not a.kwarg and (odd := sorted(given - by_name)):
        return f'No parameter named "{odd[0]}"'
    filled = set(places[: len(call.args)])
    if twice := sorted(filled & given & by_name):
        return f'Multiple values for "{twice[0]}"'
    needed = places[: len(places) - len(a.defaults)] + [p.arg for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True) if d is None]
    posonly = {p.arg for p in a.posonlyargs}
    lacking = [p for p in needed if p not in filled and (p in posonly or p not in given)]
    return f'Argument missing for parameter "{lacking[0]}"' if lacking else None


def _head(source: Source, tree: ast.Module) -> int:
    """How many characters stand before the place where imports may go: after the docstring and __future__ imports."""
    last = 0
    for k, node in enumerate(tree.body):
        doc = k == 0 and isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str)
        if not doc and not (isinstance(node, ast.ImportFrom) and node.module == "__future__"):
            break
        last = source.starts[min(node.end_lineno, len(source.starts) - 1)] if node.end_lineno < len(source.starts) else len(source.raw)
    return len(source.raw[:last].decode())


def facts(code: str | None) -> dict:
    """scopes.FACTS of a text; one that doesn't compile has one problem and nothing else."""
    tree = parse(code)
    try:
        top = symtable.symtable(code, "code", "exec") if tree is not None else None
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        top = None
    if top is None:
        return {"parses": False, "imports": [], "undefined": [], "problems": [] if code is None else [{"line": 1, "message": "Code does not compile"}], "head": 0}
    bound, used, local = set(), set(), set()
    for table in _tables(top):
        for s in table.get_symbols():
            binds = s.is_assigned() or s.is_imported() or s.is_namespace() or s.is_annotated()
            if table is top or s.is_global():
                if binds and (table is top or s.is_declared_global()):
                    bound.add(s.get_name())
                if s.is_referenced():
                    used.add(s.get_name())
            elif s.is_local():
                local.add(s.get_name())
    starred = any(isinstance(n, ast.ImportFrom) and any(a.name == "*" for a in n.names) for n in ast.walk(tree))
    undefined = set() if starred else used - bound - BUILTIN
    # Functions that one plain definition binds, and no inner scope hides.
    times: dict[str, int] = {}
    for n in ast.walk(tree):
        for name in [n.id] if isinstance(n, ast.Name) and not isinstance(n.ctx, ast.Load) else [n.name] if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) else []:
            times[name] = times.get(name, 0) + 1
    imported = {name for name, _ in imports(tree)}
    known = {f.name: f for f in tree.body if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef) and not f.decorator_list and times[f.name] == 1 and f.name not in local | imported}
    problems, first = [], {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load) and n.id in undefined:
            first[n.id] = min(first.get(n.id, n.lineno), n.lineno)
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in known and (why := _misfit(known[n.func.id], n)):
            problems.append({"line": n.lineno, "message": why})
    problems += [{"line": line, "message": f'"{name}" is not defined'} for name, line in first.items()]
    return {
        "parses": True,
        "imports": [{"name": a, "statement": b} for a, b in dict.fromkeys(imports(tree))],
        "undefined": sorted(first),
        "problems": sorted(problems, key=lambda p: (p["line"], p["message"])),
        "head": _head(Source(code), tree),
    }
