"""What the stages need from outside, as small interfaces with deterministic stand-ins.

A backend is picklable and works on one partition's rows at a time. Calls that fail give an error text instead of ending the job.
"""

from __future__ import annotations

import ast
import hashlib
import os
import random
import resource
import signal
import subprocess
import sys
import tempfile
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.names import facts


@dataclass(frozen=True)
class Retry:
    """Exponential waits between attempts."""

    attempts: int = 5
    least: float = 5.0
    most: float = 20.0

    def call(self, f: Callable, *args):
        for k in range(self.attempts):
            try:
                return f(*args)
            except Exception:
                if k + 1 == self.attempts:
                    raise
                time.sleep(min(self.most, self.least * 2**k) * (0.5 + random.random() / 2))
        return None


@dataclass(frozen=True)
class Sampling:
    """Parameters of a completion request; temperature 0 turns sampling off."""

    model: str = "stand-in"
    max_tokens: int = 512
    n: int = 1
    temperature: float = 0.0
    stop: tuple[str, ...] = ()

    @property
    def do_sample(self) -> bool:
        return self.temperature != 0


def stand_in_completion(prompt: str, seed: int, sampling: Sampling) -> list[tuple[str, str]]:
    """(finish reason, text) for each sample, from a hash of the prompt."""
    out = []
    for k in range(sampling.n):
        digest = hashlib.sha256(f"{sampling.model}|{seed}|{k}|{prompt}".encode()).hexdigest()
        out.append(("length" if digest[0] == "0" else "stop", f"{digest[:8]}, {digest[8:16]}"))
    return out


COMPLETION = "array<struct<finish_reason:string,text:string>>"


@dataclass(frozen=True)
class Completions:
    """Completions with a bounded number of requests in flight in each task."""

    complete: Callable[[str, int, Sampling], list[tuple[str, str]]] = stand_in_completion
    sampling: Sampling = Sampling()
    in_flight: int = 32
    delay: float = 0.0
    retry: Retry = field(default_factory=Retry)

    def _one(self, prompt: str | None, seed: int) -> tuple[list[dict] | None, str | None]:
        if prompt is None:
            return None, "no prompt"
        try:
            if self.delay:
                time.sleep(self.delay)
            found = self.retry.call(self.complete, prompt, seed, self.sampling)
            return [{"finish_reason": a, "text": b} for a, b in found], None
        except Exception as e:  # noqa: BLE001  a failed request is a row with its error
            return None, str(e)[:500]

    def apply(self, rows: DataFrame, prompt: str = "prompt", seed: str = "seed_value") -> DataFrame:
        """rows with choices and error."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", choices {COMPLETION}, error string"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(self.in_flight) as pool:
                for pdf in batches:
                    found = list(pool.map(self._one, pdf[prompt], pdf[seed]))
                    yield pdf.assign(choices=[f[0] for f in found], error=[f[1] for f in found])

        return rows.mapInPandas(run, schema)


def stand_in_judge(prompts: list[str], sampling: Sampling) -> list[str]:
    """Yes or no by the prompt's MD5."""
    return ["Yes" if hashlib.md5(p.encode()).hexdigest()[0] < "8" else "No" for p in prompts]


@dataclass(frozen=True)
class Batched:
    """Offline inference in batches: one model call for each, temperature 0, a few tokens, up to the first line end."""

    generate: Callable[[list[str], Sampling], list[str]] = stand_in_judge
    sampling: Sampling = Sampling(max_tokens=5, stop=("\n",))
    batch: int = 512

    def apply(self, rows: DataFrame, prompt: str = "prompt", answer: str = "answer") -> DataFrame:
        """rows with the answer; null prompts have none."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{answer}` string"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                asked = [p for p in pdf[prompt] if p is not None]
                found: list[str] = []
                for a in range(0, len(asked), self.batch):
                    found += self.generate(asked[a : a + self.batch], self.sampling)
                left = iter(found)
                yield pdf.assign(**{answer: [None if p is None else next(left) for p in pdf[prompt]]})

        return rows.mapInPandas(run, schema)


@dataclass(frozen=True)
class ImportFixer:
    """Adds missing imports, each text within a time limit; a text that fails or takes too long stays as it is."""

    fix: Callable[[str], str] | None = None
    seconds: float = 10.0

    def _one(self, code: str | None) -> str | None:
        if code is None:
            return None

        def late(*_):
            raise TimeoutError

        before = signal.signal(signal.SIGALRM, late)
        signal.setitimer(signal.ITIMER_REAL, self.seconds)
        try:
            return (self.fix or add_imports)(code)
        except Exception:  # noqa: BLE001  the original text stands for any failure
            return code
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)

    def apply(self, rows: DataFrame, code: str = "content") -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(**{code: [self._one(x) for x in pdf[code]]})

        return rows.mapInPandas(run, rows.schema)


@dataclass(frozen=True)
class Limits:
    seconds: float = 4.0
    memory: int = 1 << 30


_DONE = "seedmill: ran to the end"


def run_code(code: str, limits: Limits = Limits()) -> bool:
    """Whether code runs to its end in an interpreter of its own, within the limits.

    The child has its own process group, which is killed on a timeout, and an own temporary folder. It reports by a
    file after its last statement, so an early exit doesn't pass.
    """
    with tempfile.TemporaryDirectory() as folder:
        source, report = os.path.join(folder, "code.py"), os.path.join(folder, "report")
        with open(source, "w") as f:
            f.write(f"{code}\n\nwith open({report!r}, 'w') as _f:\n    _f.write({_DONE!r})\n")

        def limit() -> None:
            resource.setrlimit(resource.RLIMIT_AS, (limits.memory, limits.memory))
            resource.setrlimit(resource.RLIMIT_CPU, (int(limits.seconds) + 1,) * 2)

        child = subprocess.Popen([sys.executable, "-I", source], cwd=folder, stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True, preexec_fn=limit, env={"PATH": os.environ.get("PATH", "")})  # noqa: PLW1509
        try:
            code_ok = child.wait(limits.seconds) == 0
        except subprocess.TimeoutExpired:
            code_ok = False
        finally:
            try:
                os.killpg(child.pid, signal.SIGKILL)
            except ProcessLookupError:
                pass
            child.wait()
        return code_ok and os.path.exists(report)


@dataclass(frozen=True)
class Executor:
    """Runs code in child processes; opt-in, never part of a registered query."""

    run: Callable[[str], bool] = run_code
    at_once: int = 2

    def apply(self, rows: DataFrame, code: str = "code") -> DataFrame:
        """rows with passed."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", passed boolean"

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(self.at_once) as pool:
                for pdf in batches:
                    yield pdf.assign(passed=list(pool.map(self.run, pdf[code])))

        return rows.mapInPandas(work, schema)


# Modules that the stand-in import fixer knows.
KNOWN_MODULES = ("math", "random", "re", "json", "itertools", "functools", "collections", "datetime", "string", "heapq", "bisect")


def add_imports(code: str) -> str:
    """code with imports of known modules that it uses but doesn't bind; the original text on any failure."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return code
    bound = {a.asname or a.name.split(".")[0] for n in ast.walk(tree) if isinstance(n, ast.Import | ast.ImportFrom) for a in n.names}
    bound |= {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and not isinstance(n.ctx, ast.Load)} | {a.arg for n in ast.walk(tree) if isinstance(n, ast.arguments) for a in n.args + n.kwonlyargs}
    used = {n.value.id for n in ast.walk(tree) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name)}
    more = [m for m in KNOWN_MODULES if m in used - bound]
    return "".join(f"import {m}\n" for m in more) + ("\n" if more else "") + code


def parse_report(text: str) -> dict[str, int]:
    """Errors by file from a type checker's text: a file's line opens it at zero (again, if it repeats), indented
    ``- error:`` lines add one, warnings don't count, and the last line (the summary) is not read."""
    out: dict[str, int] = {}
    now = None
    for line in text.splitlines()[:-1]:
        if line.startswith(("/", ".")) and line.rstrip().endswith(".py"):
            now = line.strip()
            out[now] = 0
        elif now is not None and line.startswith(" ") and "- error:" in line:
            out[now] += 1
    return out


@dataclass(frozen=True)
class Checker:
    """Type checks in batches; this one counts one error for code that doesn't parse."""

    batch: int = 250

    def check(self, codes: list[str]) -> list[int]:
        out = []
        for code in codes:
            try:
                ast.parse(code)
                out.append(0)
            except (SyntaxError, ValueError):
                out.append(1)
        return out

    def apply(self, rows: DataFrame, code: str = "content", digest: str = "sha1") -> DataFrame:
        """(digest, errors, status); a batch whose check fails has null errors and its reason as status."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for a in range(0, len(pdf), self.batch):
                    part = pdf.iloc[a : a + self.batch]
                    try:
                        errors, status = self.check(part[code].tolist()), "ok"
                    except Exception as e:  # noqa: BLE001  a failed batch is reported
                        errors, status = [None] * len(part), str(e)[:500]
                    yield pd.DataFrame({digest: part[digest], "errors": pd.array(errors, "Int64"), "status": status})

        return rows.select(code, digest).mapInPandas(run, f"{digest} string, errors long, status string")


@dataclass(frozen=True)
class ScopeChecker(Checker):
    """Counts names that nothing binds and calls that don't fit a function of the same text."""

    def check(self, codes: list[str]) -> list[int]:
        return [len(facts(code)["problems"]) for code in codes]


@dataclass(frozen=True)
class ProcessChecker(Checker):
    """A checker that is a program: a batch's texts become files of a folder, their names its arguments, its output the report.

    A batch that takes longer than ``seconds`` is killed with all its children and has null errors; so has one whose program
    can't be run. Files that the report doesn't name have no errors.
    """

    command: tuple[str, ...] = ()
    seconds: float = 120.0

    def check(self, codes: list[str]) -> list[int]:
        names = [f"{hashlib.sha1(c.encode('utf-8', 'surrogatepass')).hexdigest()}.py" for c in codes]
        with tempfile.TemporaryDirectory() as folder:
            for name, code in dict(zip(names, codes, strict=True)).items():
                with open(os.path.join(folder, name), "w", encoding="utf-8", errors="surrogatepass", newline="") as f:
                    f.write(code)
            # The stand-in is a module of this package, wherever executors have it.
            root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
            command = self.command or (sys.executable, "-m", "seedmill.backends.name_check")
            child = subprocess.Popen([*command, *dict.fromkeys(names)], cwd=folder, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, start_new_session=True, env=os.environ | {"PYTHONPATH": os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])})
            try:
                said = child.communicate(timeout=self.seconds)[0]
            except subprocess.TimeoutExpired:
                raise TimeoutError(f"the check took over {self.seconds:g} s") from None
            finally:
                with suppress(ProcessLookupError):
                    os.killpg(child.pid, signal.SIGKILL)
                child.wait()
        errors = {os.path.basename(path): n for path, n in parse_report(said).items()}
        return [errors.get(name, 0) for name in names]
