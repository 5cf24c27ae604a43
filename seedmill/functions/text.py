"""String functions as native expressions, with Python's white-space and line rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.split() takes as white space, and where str.splitlines() breaks lines.
WS = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"

FENCE = "```"
# Group 1 is the tag line, group 2 the code; the atomic group keeps a tag from turning into code.
FENCE_RE = r"(?s)```(?>([^\n]*[^\s][^\n]*)\n|)(.*?)```"
# Blocks that open and close at line starts; group 1 is the code.
EXEC_RE = r"(?dms)^```python\s*\n(.*?)(?=^```)"
TRIPLE = '"""'


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+$", "")


def ws_key(c: Column) -> Column:
    """The text without any white space."""
    return F.regexp_replace(c, f"{WS}+", "")


def splitlines(c: Column) -> Column:
    """Lines at every Unicode line end, without an empty last one."""
    parts = F.split(c, LINE_END, -1)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def count_of(c: Column, needle: str) -> Column:
    """Occurrences that don't overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def index(c: Column, needle: str) -> Column:
    """First place from 0, or -1."""
    return (F.instr(c, needle) - 1).cast("long")


def rindex(c: Column, needle: str) -> Column:
    """Last place from 0, or -1."""
    at = F.instr(F.reverse(c), needle[::-1])
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(c) - at - len(needle) + 1).cast("long")


def fenced_blocks(c: Column, tag: str | None = None) -> Column:
    """Contents of fenced blocks, stripped; with a tag only those that carry it, in any case."""
    tags, codes = F.regexp_extract_all(c, F.lit(FENCE_RE), F.lit(1)), F.regexp_extract_all(c, F.lit(FENCE_RE), F.lit(2))
    both = F.arrays_zip(tags.alias("tag"), codes.alias("code"))
    if tag is not None:
        both = F.filter(both, lambda b: F.lower(strip(b["tag"])) == tag.lower())
    return F.transform(both, lambda b: strip(b["code"]))


def exec_blocks(c: Column) -> Column:
    """Python blocks as execution takes them: fences at line starts, exact tag."""
    return F.regexp_extract_all(c, F.lit(EXEC_RE), F.lit(1))


def unindent(c: Column) -> Column:
    """Lines without the least indentation of lines that aren't blank."""
    lines = splitlines(c)
    solid = F.filter(lines, lambda x: strip(x) != "")
    least = F.coalesce(F.array_min(F.transform(solid, lambda x: F.length(x) - F.length(F.regexp_replace(x, f"^{WS}+", "")))), F.lit(0))
    # The least indentation goes along as an array, so that it isn't computed again for each line.
    both = F.arrays_zip(lines.alias("x"), F.array_repeat(least, F.size(lines)).alias("n"))
    return F.array_join(F.transform(both, lambda b: F.substring(b["x"], b["n"] + 1, F.length(b["x"]))), "\n")


def split_docstring(c: Column) -> Column:
    """struct(doc, code): the first triple-quoted text, unindented and stripped, and the code without it; null if it lacks.

    The closing quotes are searched one character after the opening ones' start plus three, as the reference does: an
    empty docstring is missed.
    """
    a = F.locate(TRIPLE, c)
    rest = F.substring(c, a + 4, F.length(c))
    b = F.locate(TRIPLE, rest)
    doc = F.substring(c, a + 3, b)
    code = F.concat(F.substring(c, F.lit(1), a - 1), F.substring(rest, b + 3, F.length(c)))
    return F.when((a > 0) & (b > 0), F.struct(strip(unindent(doc)).alias("doc"), code.alias("code")))


def benchmark_docstring(prompt: Column) -> Column:
    """The docstring of a benchmark prompt: of two or four triple quotes, double ones first; null for anything else."""
    n, single = count_of(prompt, TRIPLE), count_of(prompt, "'''")
    part = lambda sep, k: strip(F.element_at(F.split(prompt, sep, -1), k))
    return F.when(n == 2, part(TRIPLE, 2)).when(n == 4, part(TRIPLE, 4)).when((n == 0) & (single == 2), part("'''", 2))


def cut_at(c: Column, *markers: str) -> Column:
    """The text before the first marker that it holds, tried in order."""
    out = c
    for m in reversed(markers):
        out = F.when(F.contains(c, F.lit(m)), F.substring_index(c, m, 1)).otherwise(out)
    return out


def concepts(c: Column) -> Column:
    """Comma-separated concepts, each stripped."""
    return F.transform(F.split(c, ","), lambda x: strip(x))


def properties(c: Column) -> Column:
    """Four lines ``name: value`` as struct(category, language, concepts, difficulty); null unless there are exactly four."""
    lines = F.split(strip(c), "\n")
    value = lambda k: strip(F.regexp_replace(lines[k], r"^[^:]*:", ""))
    return F.when(F.size(lines) == 4, F.struct(value(0).alias("category"), value(1).alias("language"), concepts(value(2)).alias("concepts"), value(3).alias("difficulty")))


def render_properties(p: Column) -> Column:
    return F.concat(F.lit("category: "), p["category"], F.lit("\nlanguage: "), p["language"], F.lit("\nconcepts: "), F.array_join(p["concepts"], ", "), F.lit("\ndifficulty: "), p["difficulty"])


#: An exercise's property as JSON.
PROPERTY = "category string, language string, concepts array<string>, difficulty string"


def property_json(p: Column) -> Column:
    return F.to_json(p)


def property_from_json(text: Column) -> Column:
    """struct(category, language, concepts, difficulty); null unless three are JSON strings and concepts is a JSON list."""
    raw = F.from_json(text, "category variant, language variant, concepts variant, difficulty variant")
    is_text = lambda name: F.startswith(F.schema_of_variant(raw[name]), F.lit("STRING"))
    typed = is_text("category") & is_text("language") & is_text("difficulty") & F.startswith(F.schema_of_variant(raw["concepts"]), F.lit("ARRAY"))
    return F.when(F.coalesce(typed, F.lit(False)), F.from_json(text, PROPERTY))


def chat_response(output: Column, prompt: Column, prefix: Column) -> Column:
    """A chat model's response: its output without the prompt, up to the first ``###``, right-stripped, after the response prefix."""
    return F.concat(prefix, rstrip(F.substring_index(F.substring(output, F.length(prompt) + 1, F.length(output)), "###", 1)))


def timestamp(at: Column | None = None) -> Column:
    """A time (now) as a part of file names."""
    return F.date_format(at if at is not None else F.current_timestamp(), "yyyyMMdd_HHmmss")


def stopped(text: Column, *stops: str) -> Column:
    """Whether a generated text holds any of the stop strings."""
    return F.array_contains(F.array(*(F.contains(text, F.lit(x)) for x in stops)), True)


def without_comments(c: Column) -> Column:
    """The text without comment lines inside fenced blocks.

    A line is a comment if it begins with # after its indentation; a blank line (not the first) just before a comment goes with it.
    Text outside of blocks stays as it is.
    """
    parts = F.split(c, FENCE, -1)
    n = F.size(parts)

    def clean(code: Column) -> Column:
        lines = F.split(code, "\n", -1)
        pairs = F.arrays_zip(lines.alias("x"), F.concat(F.slice(lines, 2, F.size(lines)), F.array(F.lit(""))).alias("after"))
        is_comment = lambda x: F.startswith(F.regexp_replace(x, f"^{WS}+", ""), F.lit("#"))
        # The first line holds the block's tag.
        kept = F.filter(pairs, lambda p, i: (i == 0) | ~(is_comment(p["x"]) | ((strip(p["x"]) == "") & (i > 1) & is_comment(p["after"]))))
        return F.array_join(F.transform(kept, lambda p: p["x"]), "\n")

    # Odd parts lie between an opening and a closing fence.
    return F.array_join(F.transform(parts, lambda x, i: F.when((i % 2 == 1) & (i < n - 1), clean(x)).otherwise(x)), FENCE)


def fingerprint(*args: Column, size: int = 5) -> Column:
    """First hex digits of the SHA-256 of all values as text, one after the other."""
    return F.substring(F.sha2(F.concat(*(a.cast("string") for a in args)), 256), 1, size)
