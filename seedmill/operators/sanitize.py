"""Parsing, filtering and rewriting of sectioned responses, with every flag as a field and every draw keyed by the row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import filters
from .counted import Report, keep
from .position import choose_some, draw, share


@dataclass(frozen=True)
class Flags:
    """What to drop, check and add. smart decides on sections by the row and implies comments off and augmentation at 0.5."""

    no_tests: bool = False
    no_explanation: bool = False
    no_reasoning: bool = False
    no_comments: bool = False
    no_incomplete: bool = False
    code_only: bool = False
    augmentation: float = 0.0
    raw: bool = False
    smart: bool = False
    seed: int = 0

    def __post_init__(self):
        if self.raw and (self.smart or self.no_tests or self.no_explanation or self.no_reasoning):
            raise ValueError("raw keeps all sections")
        if self.augmentation > 0 and not (self.no_tests or self.smart):
            raise ValueError("augmentation moves tests into the instruction, so they must leave the response")


def assertion_block(tests_block: Column, seed: int, *key: Column) -> Column:
    """struct(text, term): one to five assertion lines if all lines are assertions, else the whole block."""
    lines = T.splitlines(tests_block)
    only = F.forall(lines, lambda x: F.startswith(x, F.lit("assert")))
    k = F.least(F.pmod(draw(seed, *key, F.lit("k")), F.lit(5)) + 1, F.size(lines)).cast("int")
    some = choose_some(lines, k, seed, *key, F.lit("lines"))
    term = F.when(k > 1, "assertions").otherwise("assertion")
    return F.struct(F.when(only, F.array_join(some, "\n")).otherwise(tests_block).alias("text"), F.when(only, term).otherwise("test case").alias("term"))


def sanitize(rows: DataFrame, flags: Flags = Flags(), id_col: str = "id", report: Report | None = None) -> DataFrame:
    """Rows that pass all checks, with instruction and response rewritten in place; other columns stay. A report counts what each check drops."""
    seed, key = flags.seed, F.col(id_col)
    kept = rows.columns
    drop = lambda df, reason, passes: keep(df, report, "sanitize", reason, passes)
    df = drop(rows, "sections", filters.sections_in_order(F.col("response"))).withColumn("_s", filters.sections(F.col("response")))
    df = df.withColumns({"_impl": T.fenced_blocks(F.col("_s.implementation"), "python"), "_tests": T.fenced_blocks(F.col("_s.tests"), "python")})
    df = drop(df, "blocks", (F.size("_impl") > 0) & filters.has_one_test_block(F.col("_s.tests")))
    df = drop(df.withColumn("_t", filters.cut_tests(F.col("_s.tests"))), "tests", filters.meaningful_tests(F.col("_t"), F.element_at("_tests", 1)))
    implementation = F.concat(F.lit(f"{T.FENCE}python\n"), F.array_join("_impl", "\n\n"), F.lit(f"\n{T.FENCE}")) if flags.code_only else F.col("_s.implementation")
    asks_tests = F.contains(F.lower("instruction"), F.lit("test"))
    if flags.smart:
        drop_tests, drop_expl, drop_reason = ~asks_tests, share(seed, key, F.lit("explanation")) < 0.5, share(seed, key, F.lit("reasoning")) < 0.5
    else:
        drop_tests, drop_expl, drop_reason = F.lit(flags.no_tests), F.lit(flags.no_explanation), F.lit(flags.no_reasoning)
    if flags.no_incomplete or flags.smart:
        df = drop(df, "incomplete", filters.is_complete(F.col("response")))
    named = lambda tag, c: F.concat(F.lit(f"{tag}\n"), c) if flags.raw else c
    parts = [F.when(~drop_reason, named("[Reasoning]", F.col("_s.reasoning"))), named("[Implementation]", implementation), F.when(~drop_expl, named("[Explanation]", F.col("_s.explanation"))), F.when(~drop_tests, named("[Tests]", F.col("_t")))]
    response = F.array_join(F.array_compact(F.array(*parts)), "\n\n")
    if flags.no_comments or flags.smart:
        response = T.without_comments(response)
    instruction = F.col("instruction")
    p = 0.5 if flags.smart else flags.augmentation
    if p > 0:
        df = df.withColumn("_a", assertion_block(F.element_at("_tests", 1), seed, key))
        gate = F.contains(F.col("_a.text"), F.lit("assert")) & (F.size(T.splitlines(F.col("_a.text"))) <= 5) & (share(seed, key, F.lit("augment")) < p) & ~F.contains(instruction, F.lit("assert")) & ~F.contains(F.lower(instruction), F.lit("for example"))
        if flags.smart:
            gate = gate & ~asks_tests
        block = F.concat(F.lit("Your code should pass the following "), F.col("_a.term"), F.lit(f":\n{T.FENCE}python\n"), T.strip(F.col("_a.text")), F.lit(f"\n{T.FENCE}"))
        instruction = F.when(gate, F.concat(instruction, F.lit("\n\n"), block)).otherwise(instruction)
    return df.withColumns({"_response": response, "_instruction": instruction}).withColumns({"response": F.col("_response"), "instruction": F.col("_instruction")}).select(*kept)
