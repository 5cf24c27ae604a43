"""Row filters over code and responses; each gives a boolean column, so Catalyst orders and fuses them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# Words and packages that disqualify a seed, markers of incomplete responses, and the benchmark solutions
# that are too generic to count as contamination (the last one is spelled as it is compared).
BAD_WORDS = ("todo", "fixme", "bug")
BAD_PACKAGES = ("argparse", "os", "subprocess", "sys", "setuptools", "distutils", "matplotlib", "seaborn")
INCOMPLETE = ("todo", "fixme", "write your code here", "your code here", "your code goes here", "notimplemented")
GENERIC_SOLUTIONS = ("return x + y", "return len(string)", "return n**2", "return .join(strings)")
TAGS = ("[Reasoning]", "[Implementation]", "[Explanation]", "[Tests]")
FINISHED = ("stop", "eos_token")


def clean_words(code: Column) -> Column:
    """No bad word and no import of a bad package anywhere in the lower-cased text (plain substrings)."""
    return ~F.rlike(F.lower(code), F.lit("|".join(BAD_WORDS) + "|(?:import|from) (?:" + "|".join(BAD_PACKAGES) + ")"))


def few_lines(code: Column, most: int = 150) -> Column:
    return F.size(F.split(code, "\n", -1)) <= most


def takes_arguments(code: Column) -> Column:
    """No line that begins with ``def `` holds ``():``."""
    return ~F.rlike(code, F.lit(r"(?dm)^def [^\n]*\(\):"))


def has_docstring(features: Column, strict: bool = False) -> Column:
    """The first function's body opens with a docstring.

    By default as loose as the reference: a body is rejected only if its first statement is neither an expression nor
    begins with a string, and a text only if it neither starts nor ends with triple double quotes.
    """
    text = features["first_text"]
    starts, ends = F.startswith(text, F.lit(T.TRIPLE)), F.endswith(text, F.lit(T.TRIPLE))
    if strict:
        return F.coalesce(features["first_is_string"] & starts & ends, F.lit(False))
    return F.coalesce((features["first_statement_is_expr"] | features["first_is_string"]) & (starts | ends), F.lit(False))


def judged_yes(answer: Column) -> Column:
    """More yes than no in the answer, in any case."""
    low = F.lower(answer)
    return T.count_of(low, "yes") > T.count_of(low, "no")


def finished(choices: Column) -> Column:
    """The choices that ended by themselves."""
    return F.filter(choices, lambda c: c["finish_reason"].isin(*FINISHED))


def is_complete(response: Column) -> Column:
    return ~F.rlike(F.lower(response), F.lit("|".join(INCOMPLETE)))


def sections_in_order(response: Column) -> Column:
    """Each of the four tags exactly once, in their order."""
    out = F.lit(True)
    for tag in TAGS:
        out = out & (T.count_of(response, tag) == 1)
    for a, b in zip(TAGS, TAGS[1:], strict=False):
        out = out & (F.instr(response, a) < F.instr(response, b))
    return out


def sections(response: Column) -> Column:
    """struct(reasoning, implementation, explanation, tests), stripped: what follows each tag, up to the next one's first place.

    One regular expression splits the text at its first tags, so the cuts are made once.
    """
    names = [t.strip("[]") for t in TAGS]
    pattern = "(?s)^.*?" + "".join(rf"\[{n}\](.*?)" for n in names[:-1]) + rf"\[{names[-1]}\](.*)$"
    return F.struct(*(T.strip(F.regexp_extract(response, pattern, k + 1)).alias(n.lower()) for k, n in enumerate(names)))


def has_one_test_block(tests: Column) -> Column:
    return (F.size(T.fenced_blocks(tests, "python")) == 1) & (T.count_of(tests, T.FENCE) == 2)


def cut_tests(tests: Column) -> Column:
    """Tests up to their last fence; from there only what stands before the first line that begins with a slash."""
    fenced = F.substring(tests, F.lit(1), (T.rindex(tests, T.FENCE) + 3).cast("int"))
    slash = r"(?s)(?:^|(?<=[\n\r\x0B\x0C\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]))/.*"
    return F.when(F.rlike(fenced, F.lit(slash)), T.strip(F.regexp_replace(fenced, slash, ""))).otherwise(fenced)


def meaningful_tests(tests: Column, block: Column) -> Column:
    """Tests (as cut) hold an assert, and some line of their block that begins with a letter is no definition or import."""
    return F.contains(tests, F.lit("assert")) & F.exists(T.splitlines(block), lambda x: F.rlike(x, F.lit(r"^\p{L}")) & ~F.rlike(x, F.lit("^(?:def|class|import|from)")))
