"""Traces: what every step of a plan took in and gave out, observed while it runs.

``step`` marks a DataFrame; its metrics are gathered by the tasks that compute it anyway, and
come with the first action on it. ``rows`` is the trace as a table, one row a metric, to be
written beside the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run string, step string, metric string, value long"


class Trace:
    def __init__(self, spark: SparkSession, run: str):
        self.spark, self.run, self.steps = spark, run, {}

    def step(self, df: DataFrame, name: str, **metrics: Column) -> DataFrame:
        """``df``, with its rows and the given conditions counted under ``name``."""
        if name in self.steps:
            raise ValueError(f"step {name} is observed already")
        seen = Observation(f"{self.run}.{name}")
        self.steps[name] = seen
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(m) for m, c in metrics.items()])

    def rows(self) -> DataFrame:
        """(run, step, metric, value); an action must have run on every step."""
        found = [(self.run, name, metric, int(value)) for name, seen in self.steps.items() for metric, value in seen.get.items()]
        return self.spark.createDataFrame(found, SCHEMA)

    def write(self, path: str) -> None:
        self.rows().write.mode("append").partitionBy("run").parquet(path)
