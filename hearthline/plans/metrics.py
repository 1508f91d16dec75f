"""One record per run: time marks, counts, sizes, errors."""

from __future__ import annotations

import json
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUN_SCHEMA = (
    "operation string, start_ms bigint, end_ms bigint, runtime_ms bigint, "
    "attributes map<string,string>, timings_ms map<string,double>"
)


class RunMetrics:
    """Collects what a run reports about itself."""

    def __init__(self, operation: str):
        self.operation = operation
        self.start = time.time()
        self.end: float | None = None
        self.attributes: dict[str, object] = {}
        self.timings: dict[str, float] = {}

    def _elapsed(self) -> float:
        return (time.time() - self.start) * 1000

    def mark(self, name: str) -> None:
        """Milliseconds since the start, under ``name``."""
        self.attributes[name] = round(self._elapsed())

    def set(self, **values: object) -> None:
        self.attributes.update(values)

    @contextmanager
    def timed(self, name: str):
        """Duration of one step, to two places."""
        begin = time.time()
        try:
            yield
        finally:
            self.timings[name] = round((time.time() - begin) * 1000, 2)

    def fail(self, error: Exception) -> None:
        self.attributes["error"] = str(error)

    def finish(self) -> dict[str, object]:
        self.end = time.time()
        self.timings["total"] = round((self.end - self.start) * 1000, 2)
        return self.record()

    def record(self) -> dict[str, object]:
        return {"operation": self.operation, **self.attributes, "timings_ms": self.timings}

    def json(self) -> str:
        return json.dumps(self.record(), default=str)

    def frame(self, spark: SparkSession) -> DataFrame:
        end = self.end or time.time()
        row = (
            self.operation,
            round(self.start * 1000),
            round(end * 1000),
            round((end - self.start) * 1000),
            {k: str(v) for k, v in self.attributes.items()},
            {k: float(v) for k, v in self.timings.items()},
        )
        return spark.createDataFrame([row], RUN_SCHEMA)

    def append(self, spark: SparkSession, path: str) -> None:
        """Add this run to the metrics table."""
        self.frame(spark).write.mode("append").parquet(path)
