"""Prompt assembly: properties, few-shot examples, chat turns, instruction and infilling formats."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.position import choose, choose_some
from . import text as T

# Prompt formats.
SYSTEM = "You are an exceptionally intelligent coding assistant that consistently delivers accurate and reliable responses to user instructions."
PREFIXES = {"I->R": ("### Instruction\n", "\n\n### Response\n"), "S->C": ("### Snippet\n", "\n\n### Concepts\n"), "C->I": ("### Property\n", "\n\n### Instruction\n")}
DIFFICULTIES = ("easy", "medium", "hard")
CATEGORY = "code generation (function implementation)"
FEWSHOT_HEADS = ("### System: I->R", "### System: C->I", "### System: S->C")
SECTION_HEADS = ("[Code]", "[Property]", "[Instruction]", "[Solution]", "[Response]")


@dataclass(frozen=True)
class Example:
    """A few-shot example; without a solution it serves no response prompt."""

    category: str
    language: str
    concepts: tuple[str, ...]
    difficulty: str
    snippet: str
    instruction: str
    solution: str | None
    response: str

    def render(self, mode: str) -> str:
        before, after = PREFIXES[mode]
        concepts = ", ".join(self.concepts)
        given = {"I->R": self.instruction, "S->C": self.snippet, "C->I": f"category: {self.category}\nlanguage: {self.language}\nconcepts: {concepts}\ndifficulty: {self.difficulty}"}[mode]
        wanted = {"I->R": self.response, "S->C": concepts, "C->I": self.instruction}[mode]
        return before + given + after + wanted


@dataclass(frozen=True)
class Fewshots:
    systems: dict[str, str]
    examples: tuple[Example, ...]

    def valid(self, mode: str) -> list[Example]:
        return [e for e in self.examples if mode != "I->R" or e.solution is not None]


def parse_fewshots(text: str) -> Fewshots:
    """A few-shot file: three system prompts under their headings, then ``### Example n`` with five bracketed sections."""
    parts = re.split(r"(?m)^### Example \d+\s*$", text.strip())
    systems = {}
    for head, mode in zip(FEWSHOT_HEADS, ("I->R", "C->I", "S->C"), strict=True):
        systems[mode] = re.split(r"(?m)^### ", parts[0].split(head, 1)[1])[0].strip()
    examples = []
    for part in parts[1:]:
        found = re.split("|".join(re.escape(h) for h in SECTION_HEADS), part)
        if len(found) != len(SECTION_HEADS) + 1:
            raise ValueError("an example has five sections")
        snippet, props, instruction, solution, response = (x.strip() for x in found[1:])
        values = [line.split(":", 1)[1].strip() for line in props.splitlines()]
        if len(values) != 4:
            raise ValueError("a property has four lines")
        examples.append(Example(values[0], values[1], tuple(c.strip() for c in values[2].split(",")), values[3], snippet, instruction, solution or None, response))
    return Fewshots(systems, tuple(examples))


def request_prompt(fewshots: Fewshots, mode: str, k: int, seed: int, given: Column, *key: Column) -> Column:
    """System prompt, k examples drawn for the row, and the open slot, right-stripped."""
    valid = fewshots.valid(mode)
    if not 0 < k <= len(valid):
        raise ValueError(f"{k} of {len(valid)} examples")
    drawn = choose_some(F.array(*(F.lit(e.render(mode)) for e in valid)), k, seed, *key, F.lit("fewshots"))
    body = F.transform(drawn, lambda x, i: F.concat(F.lit("## Example "), (i + 1).cast("string"), F.lit("\n"), x))
    before, after = PREFIXES[mode]
    slot = F.concat(F.lit(f"## Example {k + 1}\n{before}"), given, F.lit(after))
    return T.rstrip(F.concat(F.lit(fewshots.systems[mode] + "\n\n"), F.array_join(body, "\n\n"), F.lit("\n\n"), slot))


def random_property(concepts: Column, language: Column, seed: int, *key: Column) -> Column:
    """An exercise's property with a drawn difficulty."""
    difficulty = choose(F.array(*map(F.lit, DIFFICULTIES)), seed, *key, F.lit("difficulty"))
    return F.struct(F.lit(CATEGORY).alias("category"), language.alias("language"), concepts.alias("concepts"), difficulty.alias("difficulty"))


def instruction_prompt(instruction: Column, response: Column | None = None) -> Column:
    return F.concat(F.lit(f"{SYSTEM}\n\n### Instruction\n"), instruction, F.lit("\n\n### Response\n"), response if response is not None else F.lit(""))


def chat(turns: Column, bos: str = "", eos: str = "<|endoftext|>") -> Column:
    """The chat format of an array of struct(role, text) in order; null if a turn is the system's."""
    said = F.transform(turns, lambda t: F.when(t["role"] == "user", F.concat(F.lit("### Instruction\n"), t["text"], F.lit("\n\n"))).otherwise(F.concat(F.lit("### Response\n"), t["text"], F.lit(f"{eos}\n\n"))))
    return F.when(~F.exists(turns, lambda t: t["role"] == "system"), F.concat(F.lit(f"{bos}{SYSTEM}\n\n"), F.array_join(said, ""), F.lit("### Response\n")))


def judge_prompt(examples: list[tuple[str, str, str]], doc: Column, code: Column, seed: int, *key: Column) -> Column:
    """Judge examples (docstring, code, answer) in an order drawn for the row, then the row's own question."""
    ask = lambda d, c: F.concat(F.lit("Docstring:\n"), d, F.lit("\n\nCode:\n"), c, F.lit("\n\nDoes the docstring describe the code fully? Answer yes or no.\nAnswer:"))
    shown = F.array(*(F.concat(ask(F.lit(d), F.lit(c)), F.lit(f" {a}")) for d, c, a in examples))
    return F.concat(F.array_join(choose_some(shown, len(examples), seed, *key, F.lit("judge")), "\n\n"), F.lit("\n\n"), ask(doc, code))


#: Stands for a row whose judge prompt is too long; such rows are never kept.
DUMMY = 'def dummy(): \n    """\n    """\n pass'


def inferred_template(apply: Callable[[list[tuple[str, str]]], str]) -> str:
    """The prompt template of a chat format: what it makes of placeholders, up to the response's end."""
    template = apply([("user", "{instruction}"), ("assistant", "{response}")])
    return template[: template.rindex("{response}") + len("{response}")]


#: Fill-in-the-middle marks (before the prefix, before the suffix, at the end) of three model families, named by their marks.
INFILL = {
    "fim": ("<fim_prefix>", "<fim_suffix>", "<fim_middle>"),
    "pre": ("▁<PRE>", "▁<SUF>", "▁<MID>"),
    "begin": ("<｜fim▁begin｜>", "<｜fim▁hole｜>", "<｜fim▁end｜>"),
}


def infill(family: str, prefix: Column, suffix: Column) -> Column:
    """A fill-in-the-middle prompt."""
    if family not in INFILL:
        raise ValueError(f"unknown family {family}")
    a, b, c = INFILL[family]
    return F.concat(F.lit(a), prefix, F.lit(b), suffix, F.lit(c))
