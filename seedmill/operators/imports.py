"""Missing imports, inferred from what the corpus itself imports.

An index names the statement that most files use to bind a name; a file's unbound names are looked up in it by a join.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import scopes, syntax
from .saved import saved, spread


def learn(files: DataFrame, content: str = "content", least: int = 2, share: float = 0.5) -> DataFrame:
    """name, statement, n: the statement that binds a name in at least ``least`` files and a ``share`` of those that import it."""
    bound = files.select(F.explode(scopes.scope_facts(F.col(content))["imports"]).alias("i")).select("i.*")
    uses = bound.groupBy("name", "statement").agg(F.count("*").alias("n"))
    # Of equally frequent statements the shortest, then the first by text.
    rank = F.struct("n", (-F.length("statement")).alias("length"), "statement")
    best = uses.groupBy("name").agg(F.max_by("statement", rank).alias("statement"), F.max("n").alias("n"), F.sum("n").alias("all"))
    return best.filter((F.col("n") >= least) & (F.col("n") >= F.lit(share) * F.col("all"))).select("name", "statement", "n")


def infer(files: DataFrame, index: DataFrame, content: str = "content") -> DataFrame:
    """content, statements (sorted), head for each distinct text with unbound names that the index knows."""
    facts = saved(spread(files.select(content).filter(F.col(content).isNotNull()).distinct(), content).withColumn("_f", scopes.scope_facts(F.col(content))).filter(F.size("_f.undefined") > 0).select(F.sha1(content).alias("_sha"), content, "_f.undefined", "_f.head"))
    found = facts.select("_sha", F.explode("undefined").alias("name")).join(index.select("name", "statement"), "name")
    lists = found.groupBy("_sha").agg(F.array_sort(F.collect_set("statement")).alias("statements"))
    return facts.join(lists, "_sha").select(content, "statements", "head")


def add(files: DataFrame, index: DataFrame, content: str = "content") -> DataFrame:
    """files with inferred imports in front of their code (after a docstring and __future__ imports); other columns stay."""
    more = infer(files, index, content).select(F.sha1(content).alias("_sha"), F.col("statements").alias("_statements"), F.col("head").alias("_head"))
    code = F.col(content)
    top, rest = F.substring(code, F.lit(1), F.col("_head")), F.substring(code, F.col("_head") + 1, F.length(code))
    # A docstring or import that ends the text may lack its line end; before code there is an empty line.
    gap = F.when((F.col("_head") > 0) & ~F.rlike(top, F.lit(r"[\r\n]$")), "\n").otherwise("")
    lines = F.concat(F.array_join("_statements", "\n"), F.when(F.col("_head") == 0, "\n\n").otherwise("\n"))
    fixed = F.when(F.col("_statements").isNull(), code).otherwise(F.concat(top, gap, lines, rest))
    joined = files.withColumn("_sha", F.sha1(content)).join(more, "_sha", "left")
    return joined.select(*(fixed.alias(c) if c == content else F.col(c) for c in files.columns))


@F.pandas_udf(StringType())
def _without_imports(code: pd.Series) -> pd.Series:
    return code.map(syntax.without_imports)


def without_imports(code: Column) -> Column:
    """The text without its top-level import statements (but those of __future__); null where it doesn't parse."""
    return _without_imports(code)


def precision(files: DataFrame, index: DataFrame, content: str = "content") -> DataFrame:
    """What an index recovers of files whose imports are taken away: per statement how often it was there, inferred, and both.

    files must be none of those that the index was learned from; files with unbound names of their own tell nothing and are left out.
    """
    known = spread(files.select(content).distinct(), content).withColumn("_f", scopes.scope_facts(F.col(content))).filter(F.col("_f.parses") & (F.size("_f.undefined") == 0))
    bare = saved(known.select(F.transform("_f.imports", lambda i: i["statement"]).alias("had"), without_imports(F.col(content)).alias("_bare")).filter("_bare is not null"))
    found = infer(bare.select(F.col("_bare").alias(content)), index, content).select(F.sha1(content).alias("_key"), "statements")
    both = bare.withColumn("_key", F.sha1("_bare")).join(found, "_key", "left")
    rows = both.select(F.explode(F.array_union("had", F.coalesce("statements", F.array().cast("array<string>")))).alias("statement"), "had", "statements")
    there, guessed = F.array_contains("had", F.col("statement")), F.coalesce(F.array_contains("statements", F.col("statement")), F.lit(False))
    return rows.groupBy("statement").agg(F.count_if(there).alias("there"), F.count_if(guessed).alias("inferred"), F.count_if(there & guessed).alias("right"))
