"""``python -m seedmill.backends.name_check FILE...``: a type checker's stand-in that reports unbound names and calls that don't fit.

It writes the report that ``services.parse_report`` reads: a line for each file with findings, indented lines for these, a summary.
"""

from __future__ import annotations

import os
import sys

from ..functions.names import facts


def report(paths: list[str]) -> str:
    out, n = [], 0
    for path in paths:
        with open(path, encoding="utf-8", newline="") as f:
            problems = facts(f.read())["problems"]
        if problems:
            out.append(os.path.abspath(path))
            out += [f"  {os.path.abspath(path)}:{p['line']}:1 - error: {p['message']}" for p in problems]
            n += len(problems)
    return "\n".join([*out, f"{n} errors, 0 warnings"]) + "\n"


if __name__ == "__main__":
    sys.stdout.write(report(sys.argv[1:]))
