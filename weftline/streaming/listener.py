"""What running queries report: a trace table, and an idle time that ends a query."""

from __future__ import annotations

import csv
import threading
import time
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

COLUMNS = ("Time", "Source", "Topic", "SampleTime", "PerfCounter", "Elapsed")


class Trace(StreamingQueryListener):
    """A row for each step of each named query: wall time, query, its source, the step's time, a counter and its duration in seconds."""

    def __init__(self, sink: TextIO | None = None):
        self.rows: list[tuple] = []
        self.lock = threading.Lock()
        self.writer = csv.writer(sink) if sink else None
        if self.writer:
            self.writer.writerow(COLUMNS)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = (time.time(), p.name or str(p.id), p.sources[0].description if p.sources else "", p.timestamp, time.perf_counter(), p.batchDuration / 1000)
        with self.lock:
            self.rows.append(row)
            if self.writer:
                self.writer.writerow(row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        with self.lock:
            return spark.createDataFrame(self.rows, "Time double, Source string, Topic string, SampleTime string, PerfCounter double, Elapsed double")


def snapshot(queries: list[StreamingQuery], spark: SparkSession) -> DataFrame:
    """A row for each query: rows of its last step, its rates, and whether it still runs."""
    rows = []
    for q in queries:
        p = q.lastProgress or {}
        rows.append((q.name or str(q.id), bool(q.isActive), int(p.get("numInputRows", 0)), float(p.get("inputRowsPerSecond", 0) or 0), float(p.get("processedRowsPerSecond", 0) or 0)))
    return spark.createDataFrame(rows, "endpoint_id string, active boolean, rows_window bigint, input_rate double, rate double")
