"""Counters that ride along with a query: what Spark observes while rows pass, with zeros where none did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Counters:
    """Named counts and sums of the rows that pass a point of a query.

    A condition is counted, a number is summed, each in the tasks that the query
    runs anyway: there is no second pass and nothing but one row comes to the
    driver. ``zero`` is the value of no rows, and what a query gives that had none.
    Tasks that are run again count once, as Spark takes the metrics of a
    partition from the attempt that succeeded.
    """

    def __init__(self, counts: dict[str, Column] | None = None, sums: dict[str, Column] | None = None, name: str | None = None):
        self.counts, self.sums = dict(counts or {}), dict(sums or {})
        self.observation = Observation(name) if name else Observation()
        if not self.counts and not self.sums:
            raise ValueError("nothing to count")

    @property
    def zero(self) -> dict[str, int | float]:
        return dict.fromkeys((*self.counts, *self.sums), 0)

    def watch(self, df: DataFrame) -> DataFrame:
        """df, whose next action fills the counters; a Counters watches one query."""
        counted = [F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in self.counts.items()]
        summed = [F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in self.sums.items()]
        return df.observe(self.observation, *counted, *summed)

    def values(self) -> dict[str, int | float]:
        """What was counted; waits for the watched query's action."""
        return self.zero | {k: v for k, v in self.observation.get.items() if v is not None}

    def row(self, spark: SparkSession) -> DataFrame:
        """The counters as one row, counts as bigint and sums as double."""
        got = self.values()
        schema = ", ".join([f"{k} bigint" for k in self.counts] + [f"{k} double" for k in self.sums])
        return spark.createDataFrame([tuple([int(got[k]) for k in self.counts] + [float(got[k]) for k in self.sums])], schema)


def encode_summary() -> Counters:
    """Succeeded and failed encodings of rows with ok (null: failed), as they are written."""
    return Counters({"total": F.lit(True), "succeeded": F.col("ok"), "failed": ~F.coalesce(F.col("ok"), F.lit(False))})
