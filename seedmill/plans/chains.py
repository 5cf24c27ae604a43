"""The chains of stages from end to end: seeds from source files, instructions and responses, curated rows, evaluation.

What several steps read is a table in the shared folder. Only counts and the range of positions come to the driver.

Defined results: empty tables give empty tables; equal rows are one seed when they are gathered, and an error where instructions are
written; a request that fails leaves its row out (in an evaluation it is a sample that fails); of several samples that
pass, each is a row of its own until rows are cleaned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..backends.services import Batched, Checker, Completions, Executor, ProcessChecker
from ..functions import prompts
from ..functions import text as T
from ..operators import dedup, imports, joins, position, sanitize
from ..operators.counted import Report
from ..operators.saved import released, saved, scratch_path
from ..sources.commits import Table
from . import stages


@dataclass(frozen=True)
class Gathering:
    """How seeds are judged and deduplicated; count gives a text's tokens, sample how many rows are judged at most (all, if none)."""

    examples: tuple[tuple[str, str, str], ...]
    count: Callable[[Column], Column]
    judge: Batched = field(default_factory=Batched)
    checker: Checker = field(default_factory=ProcessChecker)
    threshold: float = 0.5
    most: int = stages.JUDGE_TOKENS
    sample: int | None = None
    seed: int = 3407


def gather(files: DataFrame, benchmark: DataFrame, how: Gathering, content: str = "content") -> DataFrame:
    """Seeds (content, sha1, id) from source files: documented functions, one of each class of near copies, that type-check once
    imports are inferred from all files, pass the static filters and please the judge."""
    functions = saved(stages.extract(files, content))
    classes = dedup.near(functions, "content", "id", how.threshold)
    unique = functions.join(classes.filter("id = component").select("id"), "id", "left_semi").select("content", "id")
    index = saved(imports.learn(files.select(F.col(content).alias("content"))))
    kept = stages.static_filters(stages.typed(saved(unique), how.checker, index=index), benchmark)
    if how.sample is not None:
        kept = position.sample(kept, how.sample, how.seed, "id")
    return stages.judged(saved(kept), list(how.examples), how.judge, how.count, how.most, how.seed).select("content", "sha1", "id")


@dataclass(frozen=True)
class Mode:
    """One generation mode with its number of examples and its model."""

    name: str
    shots: int
    backend: Completions

    def fingerprint(self, fewshots: prompts.Fewshots, seed: int) -> str:
        """What ``stages.generate`` writes beside each row: a run that resumes a table must have the same."""
        parts = (self.name, self.backend.sampling.model, self.shots, seed, *(e.render(self.name) for e in fewshots.examples))
        return hashlib.sha256("".join(map(str, parts)).encode()).hexdigest()[:5]

    @property
    def adds(self) -> tuple[str, str]:
        """The column that the mode adds, and its type."""
        if self.name == "I->R":
            return ("response", "string") if self.backend.sampling.n == 1 else ("parsing_result", "array<struct<response:string>>")
        return {"S->C": ("concepts", "array<string>"), "C->I": ("instruction", "string")}[self.name]

    def schema(self, rows: DataFrame) -> StructType:
        out = StructType(list(rows.drop("prompt", "fingerprint", self.adds[0]).schema.fields))
        for name, kind in (("prompt", "string"), ("fingerprint", "string"), self.adds):
            out = out.add(name, DataType.fromDDL(kind))
        return out


def by_chunk(rows: DataFrame, number: Column, chunks: Sequence[int]) -> Callable[[int], DataFrame]:
    """Reads a chunk's rows out of a table with a folder for each of the chunks (one number for each is broadcast)."""
    spark, path, name = rows.sparkSession, scratch_path(rows.sparkSession), "_chunk"
    while name in rows.columns:
        name = "_" + name
    wanted = spark.createDataFrame([(k,) for k in chunks], f"{name} long")
    dealt = rows.withColumn(name, number).join(F.broadcast(wanted), name, "left_semi").repartitionByRange(name, "pos")
    dealt.write.partitionBy(name).parquet(path)
    return lambda k: spark.read.schema(rows.schema).parquet(f"{path}/{name}={k}")


def run_mode(rows: DataFrame, mode: Mode, fewshots: prompts.Fewshots, table: Table, chunk: int = 100_000, start: int = 0, n: int | None = None, seed: int = 3407, retry: bool = False, report: Report | None = None) -> DataFrame:
    """One mode over the positions start .. start + n of rows (with pos), in chunks of positions that the table commits one by one.

    A run that was interrupted goes on with the chunks that are not committed; requests of committed ones are not made again. With
    retry, rows that have no result yet (their request failed, or they came later) are asked for in one more commit. A table
    of another fingerprint or start is an error.
    """
    todo = position.take(rows, start, n)
    table.guard(mode.fingerprint(fewshots, seed), start)
    schema = mode.schema(rows)
    # A chunk's rows lie in few files; their requests are spread over all cores.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    ask = lambda some: stages.generate(some.repartition(cores, "pos"), mode.name, fewshots, mode.backend, mode.shots, seed, report=report)
    done = {f["chunk"] for f in table.state()[1]["files"]}
    number = position.chunk(F.col("pos"), chunk)
    left = sorted(k for (k,) in todo.select(number).distinct().collect() if k not in done)
    if left:
        with released():
            # Dealt out by chunk once, so that a chunk reads its own folder and not all rows.
            parts = by_chunk(todo, number, left)
            for k in left:
                with released():
                    table.write(ask(parts(k)), chunk=k)
    if retry:
        with released():
            missing = saved(position.resume(todo, table.read(schema), "pos"))
            if missing.limit(1).count():
                table.write(ask(missing))
    return table.read(schema)


def instruct(seeds: DataFrame, order: Sequence[str], fewshots: prompts.Fewshots, modes: Sequence[Mode], folder: str, chunk: int = 100_000, start: int = 0, n: int | None = None, seed: int = 3407, retry: bool = False) -> DataFrame:
    """Seeds through all modes, one table of commits for each under the folder; the last one's rows.

    order: columns that give each seed its position, the same in every run. A seed's draws and its request's seed depend on
    its position alone, so neither chunks nor interruptions change a result.
    """
    if dedup.assert_unique(seeds, "seed").limit(1).count():
        raise ValueError("seeds must differ")
    rows = saved(position.with_pos(seeds, *order))
    for mode in modes:
        table = Table(rows.sparkSession, f"{folder.rstrip('/')}/{mode.name.replace('->', '-to-')}")
        rows = run_mode(rows, mode, fewshots, table, chunk, start, n, seed, retry)
    return rows


def curate(rows: DataFrame, executor: Executor, cache: DataFrame | None = None, flags: sanitize.Flags = sanitize.Flags(smart=True), id_col: str = "id", report: Report | None = None) -> DataFrame:
    """Responses that run, sanitized with all sections, cleaned of copies, and sanitized again by the flags.

    Adds (or replaces) sample_id, the row's id and the sample's number: several samples of one row may pass, and cleaning tells them apart.
    """
    ran = stages.execution_filter(rows, executor, cache, report, samples=True)
    named = ran.withColumn("sample_id", F.concat_ws("-", F.col(id_col).cast("string"), "sample_idx")).drop("sample_idx")
    raw = saved(sanitize.sanitize(named, sanitize.Flags(raw=True, seed=flags.seed), "sample_id", report))
    return sanitize.sanitize(stages.clean(raw, flags.seed, "sample_id"), flags, "sample_id", report)


def evaluate(problems: DataFrame, n: int, k: int, backend: Completions, executor: Executor, seed: int = 3407, tests: str | None = None) -> DataFrame:
    """(id, n, c, pass_at_k) of problems (id, instruction, response_prefix): n samples each, of which c run, with the tests if there are any.

    A completion counts up to its first fence, after the code that the response prefix begins. A sample whose request fails has failed.
    """
    asked = joins.samples(problems, n).withColumns({"prompt": prompts.instruction_prompt(F.col("instruction"), F.col("response_prefix")), "seed_value": F.lit(seed) + F.col("sample_idx")})
    given = F.regexp_replace("response_prefix", f"^\n{T.FENCE}python\n?", "")
    parts = [given, T.cut_at(F.col("choices")[0]["text"], T.FENCE), *([F.lit("\n"), F.col(tests)] if tests else [])]
    answered = saved(backend.apply(asked).select("id", F.when(F.col("error").isNull(), F.concat(*parts)).alias("code")))
    ran = executor.apply(answered.filter("code IS NOT NULL")).select("id", "passed")
    judged = ran.unionByName(answered.filter("code IS NULL").select("id", F.lit(False).alias("passed")))
    counts = judged.groupBy("id").agg(F.count("*").alias("n"), F.count_if("passed").alias("c"))
    return counts.withColumn("pass_at_k", stages.pass_at_k("n", "c", k))
