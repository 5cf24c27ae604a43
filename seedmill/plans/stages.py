"""The stages of the instruction pipeline, from source files to training rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..backends.services import Batched, Checker, Completions, Executor, ImportFixer, ProcessChecker
from ..functions import prompts, syntax
from ..functions import text as T
from ..functions import tokens as K
from ..operators import decontam, dedup, filters, imports, joins, position
from ..operators.counted import Report, keep
from ..operators.saved import saved, spread


def extract(files: DataFrame, content: str = "content") -> DataFrame:
    """Distinct documented top-level functions with ids in the order of their digests."""
    found = syntax.functions_of(files.select(content), content).select("content")
    once = saved(found.dropDuplicates(["content"]).withColumn("sha1", F.sha1("content")))
    return position.with_pos(once, "sha1", "content", name="id").select("content", "id")


def typed(functions: DataFrame, checker: Checker = ProcessChecker(), fixer: ImportFixer | None = ImportFixer(), index: DataFrame | None = None) -> DataFrame:
    """Functions that return a value and type-check once missing imports are added, with their digest.

    Imports come from an index learned from a corpus (``operators.imports``) if one is given, else from the fixer.
    """
    df = functions.withColumn("_f", syntax.code_features(F.col("content"))).filter("_f.has_return").drop("_f")
    fixed = imports.add(df, index) if index is not None else fixer.apply(df) if fixer else df
    df = saved(fixed.withColumn("sha1", F.sha1("content")))
    return joins.with_verdicts(df, checker.apply(spread(df.dropDuplicates(["sha1"]), "sha1")))


def static_filters(functions: DataFrame, benchmark: DataFrame, content: str = "content") -> DataFrame:
    """All static filters; the native ones run before the anti-join, parsing last."""
    c = F.col(content)
    df = functions.filter(filters.clean_words(c) & filters.few_lines(c) & filters.takes_arguments(c))
    df = decontam.decontaminate(df, benchmark, content)
    df = df.withColumn("_f", syntax.code_features(c))
    return df.filter(F.col("_f.has_return") & filters.has_docstring(F.col("_f"))).drop("_f")


#: Tokens that a judge's examples and a row's code may have together.
JUDGE_TOKENS = 16_380


def judged(rows: DataFrame, examples: list[tuple[str, str, str]], backend: Batched, count: Callable[[Column], Column], most: int = JUDGE_TOKENS, seed: int = 3407, content: str = "content", key: str = "id") -> DataFrame:
    """Rows that a judge says yes to. count gives a text's tokens; a row that is too long is asked about a dummy and left out.

    The answer is a column of its row, so nothing is aligned by position.
    """
    ask = lambda c: prompts.judge_prompt(examples, T.split_docstring(c)["doc"], T.split_docstring(c)["code"], seed, F.col(key))
    around = count(ask(F.lit(prompts.DUMMY))) - count(F.lit(prompts.DUMMY))
    df = rows.withColumn("_long", count(F.col(content)) + around > most)
    df = df.withColumn("_prompt", F.when(F.col("_long"), ask(F.lit(prompts.DUMMY))).otherwise(ask(F.col(content))))
    kept = filters.judged_yes(F.col("_answer")) & ~F.contains(F.col(content), F.lit("def dummy()")) & ~F.col("_long")
    return backend.apply(df, "_prompt", "_answer").filter(kept).drop("_long", "_prompt", "_answer")


def seeds(functions: DataFrame) -> DataFrame:
    """The name under which generation takes functions."""
    return functions.withColumnRenamed("content", "seed")


def generate(rows: DataFrame, mode: str, fewshots: prompts.Fewshots, backend: Completions, k: int, seed: int = 3407, pos: str = "pos", report: Report | None = None) -> DataFrame:
    """One generation mode over rows with pos: prompt, request, finished choices, parsed output.

    Adds prompt and fingerprint (replacing older ones) and concepts, instruction, response, or parsing_result if there is more
    than one sample. Rows without a finished choice or with an error are left out, and counted if there is a report.
    """
    language = joins.language_name(F.col("data_dir")) if "data_dir" in rows.columns else F.lit("Python")
    key = F.col(pos)
    given = {"S->C": lambda: F.col("seed"), "I->R": lambda: F.col("instruction"), "C->I": lambda: T.render_properties(prompts.random_property(F.col("concepts"), language, seed, key))}[mode]()
    asked = rows.drop("prompt", "fingerprint").withColumns({"prompt": prompts.request_prompt(fewshots, mode, k, seed, given, key), "seed_value": F.lit(seed) + key})
    answered = keep(backend.apply(asked), report, "generate", "error", F.col("error").isNull())
    done = saved(keep(answered.withColumn("choices", filters.finished(F.col("choices"))), report, "generate", "unfinished", F.size("choices") > 0))
    first = F.col("choices")[0]["text"]
    parts = (mode, backend.sampling.model, k, seed, *(e.render(mode) for e in fewshots.examples))
    done = done.withColumn("fingerprint", T.fingerprint(*map(F.lit, parts)))
    if mode == "S->C":
        done = done.withColumn("concepts", T.concepts(first))
    elif mode == "C->I":
        done = done.withColumn("instruction", T.strip(first))
    elif backend.sampling.n == 1:
        done = done.withColumn("response", T.strip(first))
    else:
        done = done.withColumn("parsing_result", F.transform("choices", lambda c: F.struct(T.strip(c["text"]).alias("response"))))
    return done.drop("choices", "error", "seed_value")


def tasks(rows: DataFrame, report: Report | None = None) -> DataFrame:
    """One row for each response with its compilable code and its number, sample_idx; responses without any are left out."""
    samples = F.col("parsing_result") if "parsing_result" in rows.columns else F.array(F.struct(F.col("response").alias("response")))
    df = rows.select(*(c for c in rows.columns if c not in ("parsing_result", "response", "sample_idx")), F.posexplode(samples).alias("sample_idx", "_r")).withColumn("response", F.col("_r.response")).drop("_r")
    df = df.withColumn("code", F.array_join(syntax.compilable(T.exec_blocks(F.col("response"))), "\n"))
    return keep(df, report, "execute", "uncompilable", F.col("code") != "")


def execution_filter(rows: DataFrame, executor: Executor, cache: DataFrame | None = None, report: Report | None = None, samples: bool = False) -> DataFrame:
    """Responses whose code runs; code found in the cache (responses of an earlier run) passes without running.

    With samples, sample_idx stays, which tells a row's responses apart. A report counts responses without code, cached and active ones, and those that failed.
    """
    todo = tasks(rows, report)
    if cache is None:
        todo = todo.withColumn("_cached", F.lit(False))
    else:
        hits = tasks(cache).select("code").distinct().withColumn("_hit", F.lit(True))
        todo = todo.join(hits, "code", "left").withColumn("_cached", F.col("_hit").isNotNull()).drop("_hit")
    if report:
        todo = report.count(todo, "execute", cached=F.col("_cached"), active=~F.col("_cached"))
    todo = saved(todo)
    cached, active = todo.filter("_cached").drop("_cached"), todo.filter("not _cached").drop("_cached")
    passed = saved(keep(executor.apply(active), report, "execute", "failed", F.col("passed")).drop("passed"))
    out = cached.unionByName(passed) if cache is not None else passed
    return out.drop("code") if samples else out.drop("code", "sample_idx")


def clean(rows: DataFrame, seed: int = 0, id_col: str = "id", by_names: bool = False) -> DataFrame:
    """Greedy dedup on instruction and response keys, and on function names if asked, in a seeded order."""
    df = rows.withColumns({"_i": T.ws_key(F.col("instruction")), "_r": T.ws_key(F.col("response"))})
    keys = [F.col("_i"), F.col("_r")]
    if by_names:
        # The first fenced block, whatever its tag; a response without one is left out, as one whose code does not parse.
        df = saved(df.withColumn("_n", syntax.code_features(F.get(T.fenced_blocks(F.col("response")), F.lit(0)))["function_names"]))
        keys.append(F.col("_n"))
    kept = dedup.greedy(df, keys, [position.draw(seed, F.col(id_col))], id_col)
    return rows.join(kept, id_col, "left_semi")


def training(rows: DataFrame, most: int = 1216, prompt: str = "instruction", response: str = "response", tokenizer: K.Tokenizer | None = None) -> DataFrame:
    """Supervised examples of all rows, by a tokenizer's ids (without one: by the toy of word digests)."""
    examples = supervised(rows, most, prompt, response, tokenizer)
    return examples.select("input_ids", "labels", "exceeding_length")


def supervised(rows: DataFrame, most: int = 1216, prompt: str = "instruction", response: str = "response", tokenizer: K.Tokenizer | None = None) -> DataFrame:
    """rows with input_ids, labels and exceeding_length; each text is encoded once, for cap, frame and collation alike."""
    encode = tokenizer.encode if tokenizer else K.word_ids
    marks = {"bos": tokenizer.id_of(tokenizer.bos), "eos": tokenizer.id_of(tokenizer.eos)} if tokenizer else {}
    ids = rows.withColumns({"_p": encode(prompts.instruction_prompt(F.col(prompt))), "_r": encode(F.col(response))})
    return ids.withColumn("_e", K.supervised(F.col("_p"), F.col("_r"), most, **marks)).select(*rows.columns, "_e.*")


def pass_at_k(n: str, c: str, k: int):
    """The unbiased estimate of pass@k from n samples with c correct ones (Chen et al., 2021)."""
    n_, c_ = F.col(n), F.col(c)
    miss = F.aggregate(F.sequence(n_ - c_ + 1, n_), F.lit(1.0), lambda p, i: p * (1 - F.lit(float(k)) / i))
    return F.when(n_ - c_ < k, F.lit(1.0)).when(c_ == 0, F.lit(0.0)).otherwise(1 - miss)


def mbpp_problem(prompt, task_id):
    """struct(id, instruction, response_prefix) from a prompt with its docstring in triple quotes and an assertion in it."""
    doc = F.regexp_extract(prompt, r'(?s)"""(.*)"""', 1)
    text, assertion = T.strip(F.substring_index(doc, "assert", 1)), T.strip(F.substring(doc, F.locate("assert", doc), F.length(doc)))
    text = F.when(F.endswith(text, F.lit(".")), text).otherwise(F.concat(text, F.lit(".")))
    instruction = F.concat(text, F.lit(f"\n\nYour code should pass the following assertion:\n{T.FENCE}python\n"), assertion, F.lit(f"\n{T.FENCE}"))
    return F.struct(task_id.cast("string").alias("id"), instruction.alias("instruction"), F.lit(f"\n{T.FENCE}python").alias("response_prefix"))


def humaneval_problem(prompt, task_id):
    body = T.strip(prompt)
    instruction = F.concat(F.lit(f"Write a Python function to solve the given task:\n{T.FENCE}python\n"), body, F.lit(f"\n{T.FENCE}"))
    return F.struct(task_id.cast("string").alias("id"), instruction.alias("instruction"), F.concat(F.lit(f"\n{T.FENCE}python\n"), body).alias("response_prefix"))
