"""Timings of stages, and running statistics."""

from __future__ import annotations

import contextlib
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def stage_times(log: DataFrame, most: int = 50) -> DataFrame:
    """run_id, step, name, took (ms since the step before), total (ms of the run); at most ``most`` steps a run."""
    w = Window.partitionBy("run_id").orderBy("step")
    run = Window.partitionBy("run_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    out = log.select("run_id", "step", "name", F.coalesce(ms - F.lag(ms).over(w), F.lit(0)).alias("took"), (F.max(ms).over(run) - F.min(ms).over(run)).alias("total"))
    return out.where(F.col("step") <= most)


def running(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with the mean and the peak of ``value`` so far in each key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("mean", F.avg(value).over(w)).withColumn("peak", F.max(value).over(w))


class StageLog:
    """Wall times and row counts of a run's stages, appended to a log that all runs share.

    Rows are counted as they are written, by an observation, so nothing is read twice: ``with log.stage("detect") as s:
    s.watch(df).write...``. ``close`` appends the run; ``session_averages`` sums up the log.
    """

    SCHEMA = "run string, step int, stage string, ms long, rows long"

    def __init__(self, spark: SparkSession, run: str, path: str):
        self.spark, self.run, self.path = spark, run, path
        self.rows: list[tuple] = []

    @contextlib.contextmanager
    def stage(self, name: str):
        s = Stage(name)
        began = time.monotonic()
        rows = None
        try:
            yield s
            rows = s.rows()
        finally:
            self.rows.append((self.run, len(self.rows), name, round((s.ended or time.monotonic() - began) * 1000), rows))

    def close(self) -> None:
        """Append the stages and their total (stage null); a stage that failed is there too, without rows."""
        total = (self.run, len(self.rows), None, sum(r[3] for r in self.rows), None)
        self.spark.createDataFrame([*self.rows, total], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        self.rows = []


class Stage:
    """What a stage writes, counted on the way."""

    def __init__(self, name: str):
        self.name, self.seen, self.began, self.ended = name, None, time.monotonic(), None

    def watch(self, df: DataFrame) -> DataFrame:
        self.seen = Observation(f"{self.name}-{uuid.uuid4().hex}")
        return df.observe(self.seen, F.count(F.lit(1)).alias("rows"))

    def rows(self, wait: float = 5.0) -> int | None:
        """The rows written; None if none were watched, or if the listener hasn't heard of the write's end in time."""
        self.ended = time.monotonic() - self.began
        while self.seen is not None and time.monotonic() < self.began + self.ended + wait:
            if self.seen._jo.future().isCompleted():
                return self.seen.get["rows"]
            time.sleep(0.01)
        return None


def session_averages(log: DataFrame) -> DataFrame:
    """stage (null: whole runs), runs, mean and longest ms, rows: of all runs in the log."""
    return log.groupBy("stage").agg(F.countDistinct("run").alias("runs"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("most_ms"), F.sum("rows").alias("rows"))
