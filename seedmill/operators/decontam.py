"""Decontamination by whole benchmark strings, and the named sets of them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType

from ..functions import text as T
from .filters import GENERIC_SOLUTIONS

#: Bytes of benchmark strings that are broadcast at once, and characters of each that the automaton holds (the rest is compared).
BLOCK_BYTES, WINDOW = 8 << 20, 48

# Languages, source sets and variations of the multi-language benchmark, and the pair of the last two that doesn't exist.
LANGUAGES = ("cpp", "cs", "d", "go", "java", "jl", "js", "lua", "php", "pl", "py", "r", "rb", "rkt", "rs", "scala", "sh", "swift", "ts")
SOURCE_SETS, VARIATIONS, ABSENT = ("humaneval", "mbpp"), ("", "-remove"), ("mbpp", "-remove")


def named(name: str, rows: DataFrame, column: str, stripped: bool = True) -> DataFrame:
    """One benchmark's strings as (name, text); empty ones are dropped, as they would match everything."""
    value = T.strip(F.col(column)) if stripped else F.col(column)
    return rows.select(F.lit(name).alias("name"), value.alias("text")).filter("text <> ''")


def registry(sets: list[DataFrame]) -> DataFrame:
    """The union of named sets without the solutions that are too generic."""
    return reduce(DataFrame.unionByName, sets).filter(~F.col("text").isin(*GENERIC_SOLUTIONS))


def solutions(rows: DataFrame, column: str = "solutions") -> DataFrame:
    """Solutions from a column of JSON arrays; empty strings count as no array."""
    return rows.filter(F.col(column) != "").select(F.explode(F.from_json(column, "array<string>")).alias("text"))


#: What stands before the solution in prompts that are files; the first one that a text holds counts.
SOLUTION_MARKS = ("SOLUTION START", "BEGIN SOLUTION")


def prompt_files(texts: DataFrame, column: str = "text", strict: bool = True) -> DataFrame:
    """(name, text) of prompts that are whole files (``files.read_whole_texts``), up to the mark of their solution.

    A text must hold its mark once. One that doesn't is an error if strict, else it is left out; so are null texts.
    """
    c = F.col(column)
    times = reduce(lambda other, m: F.when(F.contains(c, F.lit(m)), T.count_of(c, m)).otherwise(other), reversed(SOLUTION_MARKS), F.lit(0))
    once = F.coalesce(times == 1, F.lit(False))
    kept = once if not strict else F.when(c.isNull() | once, c.isNotNull()).otherwise(F.raise_error(F.lit("a prompt without one mark of its solution")).cast("boolean"))
    return named("prompt_files", texts.filter(kept).select(T.cut_at(c, *SOLUTION_MARKS).alias("prompt")), "prompt", False)


def multi_language(read: Callable[[str], DataFrame], column: str = "prompt") -> DataFrame:
    """The union of the multi-language benchmark's sets: read takes ``source-language`` and a variation's suffix."""
    names = [f"{source}-{lang}{v}" for lang in LANGUAGES for source in SOURCE_SETS for v in VARIATIONS if (source, v) != ABSENT]
    return reduce(DataFrame.unionByName, [read(name).select(F.lit(name).alias("name"), T.strip(F.col(column)).alias("text")) for name in names])


def standard_sets(mbpp: DataFrame, humaneval: DataFrame) -> DataFrame:
    """The four named sets: prompts and code of the first as they are, docstrings and solutions of the second stripped."""
    docs = humaneval.select(T.benchmark_docstring(F.col("prompt")).alias("prompt"))
    return registry([
        named("mbpp_docstrings", mbpp, "prompt", False),
        named("mbpp_solutions", mbpp, "code", False),
        named("human_eval_docstrings", docs, "prompt"),
        named("human_eval_solutions", humaneval, "canonical_solution"),
    ])


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The distinct strings, in parts that are small enough to broadcast."""
    texts = benchmark.select("text").filter("text <> ''").distinct()
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    n = max(1, -(-int(total) // block_bytes))
    return [texts if n == 1 else texts.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k) for k in range(n)]


def _automaton(texts: list[str]) -> ahocorasick.Automaton:
    """A window of each string, with the numbers of the strings that are known by it and where it stands in them.

    Of a string's first, middle and last window the one that fewest strings share is taken: many begin alike.
    """
    starts = [sorted({0, max(0, len(t) - WINDOW) // 2, max(0, len(t) - WINDOW)}) for t in texts]
    shared = Counter(t[a : a + WINDOW] for t, of in zip(texts, starts, strict=True) for a in of)
    held: dict[str, list[tuple[int, int]]] = {}
    for k, (t, of) in enumerate(zip(texts, starts, strict=True)):
        a = min(of, key=lambda a: shared[t[a : a + WINDOW]])  # noqa: B023
        held.setdefault(t[a : a + WINDOW], []).append((k, a))
    out = ahocorasick.Automaton()
    for window, numbers in held.items():
        out.add_word(window, (len(window), numbers))
    out.make_automaton()
    return out


def _occurs(text: str, texts: list[str], known: ahocorasick.Automaton) -> Iterator[int]:
    """Numbers of the strings that a text holds, once for each place."""
    for end, (size, numbers) in known.iter(text):
        for k, a in numbers:
            begin = end - size + 1 - a
            if begin >= 0 and text.startswith(texts[k], begin):
                yield k


def held_strings(texts: list[str]) -> Callable[[Column], Column]:
    """An Arrow UDF: the numbers of the strings (a measured block) that a text holds; null for null."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _automaton(texts) if texts else None

        def one(text: str | None) -> list[int] | None:
            if text is None or known is None:
                return None if text is None else []
            return sorted(set(_occurs(text, texts, known)))

        for s in batches:
            yield s.map(one, na_action=None)

    return find


def _in_turn(held: list[Broadcast]) -> Iterator[list[str]]:
    """The blocks, one in memory at a time; a single one stays for the worker's next batches."""
    for block in held:
        yield block.value
        # Without its value a broadcast is read again from its file; one that came without a file keeps it.
        if len(held) > 1 and getattr(block, "_path", None):
            block.__dict__.pop("_value", None)


def holds_any(held: list[Broadcast]) -> Callable[[Column], Column]:
    """An Arrow UDF: whether a text holds a string of any block; the blocks take turns in one worker. False for null."""

    @F.pandas_udf(BooleanType())
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept = None
        for s in batches:
            found = [False] * len(s)
            for texts in _in_turn(held):
                known = kept or (_automaton(texts) if texts else None)
                kept = known if len(held) == 1 else None
                for k, text in enumerate(s):
                    if known is not None and text is not None and not found[k]:
                        found[k] = next(_occurs(text, texts, known), None) is not None
            yield pd.Series(found)

    return find


def decontaminate(rows: DataFrame, benchmark: DataFrame, column: str = "content", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that hold no benchmark string (case-sensitive): one scan, with an automaton for each block of strings in turn."""
    context = rows.sparkSession.sparkContext
    held = [context.broadcast(sorted(r.text for r in block.collect())) for block in _blocks(benchmark, block_bytes)]  # at most block_bytes each
    return rows.filter(~holds_any(held)(F.col(column)))


def contaminated_pairs(rows: DataFrame, benchmark: DataFrame, column: str = "content", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every (row, string) such that the row holds the string, with the strings' columns prefixed ``bench_``."""
    spark = rows.sparkSession
    bench = benchmark.select(*(F.col(c).alias(f"bench_{c}") for c in benchmark.columns))
    out = []
    for block in _blocks(benchmark, block_bytes):
        texts = sorted(r.text for r in block.collect())
        numbered = spark.createDataFrame(list(enumerate(texts)), "_number int, bench_text string")
        found = rows.withColumn("_number", F.explode(held_strings(texts)(F.col(column))))
        out.append(found.join(F.broadcast(numbered), "_number").drop("_number").join(bench, "bench_text"))
    return reduce(DataFrame.unionByName, out)


def counts(benchmark: DataFrame) -> DataFrame:
    return benchmark.groupBy("name").agg(F.count("*").alias("n"))
