"""Events of running plans: metrics and summaries that Spark gathers while a batch or a stream passes by.

Metrics are aggregates observed within the plan itself, so they cost no pass of their own.  Events are
rows ``(kind, run_id, step, time, name, value)`` and can be written as a table.
"""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "kind string, run_id string, step long, time double, name string, value double"


def summary(column: str) -> dict[str, Column]:
    """Least, greatest, mean, deviation (of the population) of a column's finite values, and the share that is finite; nulls don't count."""
    x = F.col(column).cast("double")
    fine = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    made = {"min": F.min(fine), "max": F.max(fine), "mean": F.avg(fine), "std": F.stddev_pop(fine), "finite": F.count(fine) / F.count(x)}
    return {f"{column}.{name}": f for name, f in made.items()}


class Run:
    """Collects the events of one run.  Step numbers are the caller's for batches, Spark's batch numbers for streams."""

    def __init__(self, spark: SparkSession, run_id: str | None = None, **config):
        self.spark, self.run_id, self.rows = spark, run_id or uuid.uuid4().hex, []
        self._lock, self._listener = threading.Lock(), None
        self._add("run.start", 0, "config", None)
        for name, value in config.items():
            self._add("config", 0, name, float(value))

    def _add(self, kind: str, step: int, name: str, value: float | None) -> None:
        with self._lock:
            self.rows.append((kind, self.run_id, step, time.time(), name, None if value is None else float(value)))

    def metric(self, step: int, name: str, value: float) -> None:
        self._add("metric", step, name, value)

    def observe(self, df: DataFrame, step: int, metrics: dict[str, Column]) -> tuple[DataFrame, _Pending]:
        """``df`` that gathers ``metrics`` when it is run; the second result's ``emit`` turns them into events then."""
        seen = Observation(f"{self.run_id}-{step}-{uuid.uuid4().hex}")
        return df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), _Pending(self, seen, step)

    def watch_streams(self) -> None:
        """From now on, metrics that streams observe under this run's id (``observe_stream``), and their numbers of input rows, become events."""
        run = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event):
                pass

            def onQueryProgress(self, event):
                progress = event.progress
                row = progress.observedMetrics.get(run.run_id)
                if row is not None:
                    run._add("metric", progress.batchId, "input_rows", progress.numInputRows)
                    for name, value in row.asDict().items():
                        run._add("metric", progress.batchId, name, value)

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                pass

        self._listener = Listener()
        self.spark.streams.addListener(self._listener)

    def observe_stream(self, df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
        return df.observe(self.run_id, *[c.alias(n) for n, c in metrics.items()])

    def close(self) -> None:
        if self._listener is not None:
            self.spark.streams.removeListener(self._listener)
            self._listener = None

    def events(self) -> DataFrame:
        """All events so far, few enough for the driver: one a metric and step."""
        with self._lock:
            return self.spark.createDataFrame(list(self.rows), SCHEMA)


class _Pending:
    def __init__(self, run: Run, seen: Observation, step: int):
        self.run, self.seen, self.step = run, seen, step

    def emit(self) -> dict[str, float]:
        """Waits for the first action on the observed table and returns its metrics."""
        found = self.seen.get
        for name, value in found.items():
            self.run._add("metric", self.step, name, value)
        return found
