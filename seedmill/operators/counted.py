"""Filters that count what they drop in the run that drops it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Report:
    """Counts of stages, by observed metrics: no job of their own, and nothing is computed twice.

    A count is complete once the rows that passed its filter have been written or counted. The filters of the stages lie in the
    job that writes the stage's table, where a retried task counts once.
    """

    def __init__(self):
        self._seen: list[tuple[str, str, Observation]] = []

    def filter(self, rows: DataFrame, stage: str, reason: str, condition: Column) -> DataFrame:
        """The rows that meet a condition; the others (null too) are counted under the reason."""
        seen = Observation()
        self._seen.append((stage, reason, seen))
        # The condition is a column below the counts, so that it is computed once.
        name = "_keep"
        while name in rows.columns:
            name += "_"
        kept = rows.withColumn(name, F.coalesce(condition, F.lit(False)))
        return kept.observe(seen, F.count("*").alias("rows_in"), F.count_if(~F.col(name)).alias("dropped")).filter(name).drop(name)

    def count(self, rows: DataFrame, stage: str, **kinds: Column) -> DataFrame:
        """The same rows; those that meet a kind's condition are counted under its name."""
        for kind, condition in kinds.items():
            seen = Observation()
            self._seen.append((stage, kind, seen))
            rows = rows.observe(seen, F.count("*").alias("rows_in"), F.count_if(condition).alias("counted"))
        return rows

    def counts(self) -> list[tuple[str, str, int, int]]:
        """(stage, reason, rows that came in, rows dropped or counted), in the order of the plan; waits for runs that have begun."""
        return [(stage, reason, (m := seen.get)["rows_in"], m.get("dropped", m.get("counted"))) for stage, reason, seen in self._seen]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.counts(), "stage string, reason string, rows_in long, n long")


def keep(rows: DataFrame, report: Report | None, stage: str, reason: str, condition: Column) -> DataFrame:
    """A filter, counted if there is a report."""
    return report.filter(rows, stage, reason, condition) if report else rows.filter(condition)
