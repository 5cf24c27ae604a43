"""Look-ups, splits by earlier results, cross products and common keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Language codes and their names.
LANGUAGES = (("cpp", "C++"), ("java", "Java"), ("php", "PHP"), ("python", "Python"), ("rust", "Rust"), ("typescript", "TypeScript"))


def language_name(code: Column, default: str = "Python") -> Column:
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES for x in pair))
    return F.coalesce(F.element_at(names, code), F.lit(default))


def split_cached(rows: DataFrame, cache: DataFrame, key: str = "code") -> tuple[DataFrame, DataFrame]:
    """(rows whose key is in the cache, the others)."""
    keys = cache.select(key).distinct()
    return rows.join(keys, key, "left_semi"), rows.join(keys, key, "left_anti")


def with_verdicts(rows: DataFrame, verdicts: DataFrame, digest: str = "sha1") -> DataFrame:
    """Rows without errors in the verdicts (digest, errors); rows that no verdict names stay, those of a failed batch (null errors) go."""
    said = verdicts.select(digest, F.coalesce("errors", F.lit(1)).alias("_errors"))
    return rows.join(said, digest, "left").filter(F.coalesce("_errors", F.lit(0)) == 0).drop("_errors")


def samples(problems: DataFrame, n: int) -> DataFrame:
    """Every problem n times, with sample_idx; a generated column and no join."""
    return problems.withColumn("sample_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def batched(problems: DataFrame, n_batches: int) -> DataFrame:
    """Every problem in every batch."""
    return problems.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_batches - 1).cast("long"))))


def common_keys(lines: DataFrame, column: str = "value") -> list[str]:
    """Keys that every JSON line has; a key with a null value counts."""
    keys = lines.select(F.explode(F.array_distinct(F.json_object_keys(column))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    total = lines.count()
    return sorted(r.key for r in keys.filter(F.col("n") == total).collect())


def without(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.drop(*columns)
