"""Streams: gates with state, windows, draining, termination and pacing."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from weftline.operators.messages import GateState
from weftline.session import shared_dir

#: What a session must be set to where a query with a gate starts; the query keeps it.
GATE_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """A session with these settings for a while, then with its own again."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(stream: DataFrame, mode: str = "append", started_with: dict[str, str] | None = None) -> DataFrame:
    """All that is there by now, as a batch: runs to the end of the available data and reads what was written.

    mode complete: the result after the last step, windows that are still open included.
    started_with: settings of the query alone.
    """
    at = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "complete":
        stream.sparkSession.createDataFrame([], stream.schema).write.parquet(f"{at}/out")
        out = out.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out"))
    else:
        out = out.format("parquet").option("path", f"{at}/out")
    with settings(stream.sparkSession, started_with or {}):
        q = out.start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


class _Gate(StatefulProcessor):
    """open and handled of each key live in the state store: unlike a process's own, they survive a failure."""

    def __init__(self, order_by: str, start_open: bool, default_open: bool, default_after: int | None, columns: Sequence[str]):
        self.order_by, self.columns = order_by, list(columns)
        self.start_open, self.default_open, self.default_after = start_open, default_open, default_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gate", StructType([StructField("open", BooleanType()), StructField("handled", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        gate = GateState(self.start_open, self.default_open, self.default_after)
        if self.state.exists():
            gate.open, gate.handled = self.state.get()
        some = pd.concat(list(rows)).sort_values([self.order_by, "gate_side"], kind="stable")
        keep = []
        for side, turned in zip(some["gate_side"], some["gate_open"], strict=True):
            if side == 0:
                gate.turn(bool(turned))
                keep.append(False)
            else:
                keep.append(gate.handle())
        self.state.update((bool(gate.open), int(gate.handled)))
        yield some.loc[keep, self.columns]

    def close(self) -> None:
        pass


def gate(messages: DataFrame, key: str, order_by: str, controls: DataFrame | None = None, start_open: bool = False, default_open: bool = False, default_after: int | None = None) -> DataFrame:
    """A stream's messages that a gate lets pass, for each key; controls: a stream of (key, order_by, open).

    Within a step rows are taken in order; the state is kept between steps.
    A step's rows of one key meet in one task, so steps bound its memory.  The
    query needs GATE_SETTINGS when it starts; the session is left as it is.
    """
    both = messages.select("*", F.lit(None).cast("boolean").alias("gate_open"), F.lit(1).alias("gate_side"))
    if controls is not None:
        both = both.unionByName(controls.select(key, order_by, F.col("open").alias("gate_open"), F.lit(0).alias("gate_side")), allowMissingColumns=True)
    return both.groupBy(key).transformWithStateInPandas(_Gate(order_by, start_open, default_open, default_after, messages.columns), messages.schema, "Append", "None")


def tumbling_counts(stream: DataFrame, ts: str, width: str, late: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count and sum of value by event-time window; a window appears once the watermark has passed it."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = timed.groupBy(F.window("_ts", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, ts: str, gap: str, late: str | None, keys: Sequence[str]) -> DataFrame:
    """Count by session of each key.  late None: no watermark, so that no row is late; for mode complete."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed if late is None else timed.withWatermark("_ts", late)
    return timed.groupBy(F.session_window("_ts", gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def fan_out(stream: DataFrame, sinks: Sequence[Callable[[DataFrame, int], None]], **options: str) -> StreamingQuery:
    """Every sink gets every step: its rows are computed once."""

    def step(df: DataFrame, n: int) -> None:
        df = df.persist()
        try:
            for s in sinks:
                s(df, n)
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(step).options(**options).start()


def newest_per_step(stream: DataFrame, n: int, order_by: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """A subscriber that drops the oldest: of each step only its newest n messages."""
    return stream.writeStream.foreachBatch(lambda df, i: sink(df.orderBy(F.desc(order_by)).limit(n), i)).start()


def stop_after_total(stream: DataFrame, total: int, sink: Callable[[DataFrame, int], None], timeout: float = 60.0) -> int:
    """Runs until so many messages have come; returns how many did."""
    seen, done = [0], threading.Event()

    def step(df: DataFrame, n: int) -> None:
        sink(df, n)
        seen[0] += df.count()
        if seen[0] >= total:
            done.set()

    q = stream.writeStream.foreachBatch(step).start()
    done.wait(timeout)
    q.stop()
    return seen[0]


def stop_when_idle(q: StreamingQuery, seconds: float = 2.0, poll: float = 0.25) -> None:
    """Stops a query once no row has come for a while; the clock starts with the first row."""
    last, before = None, -1
    while q.isActive:
        p = q.lastProgress
        if p is not None and p["numInputRows"] and p["batchId"] != before:
            last, before = time.monotonic(), p["batchId"]
        if last is not None and time.monotonic() - last > seconds:
            q.stop()
        time.sleep(poll)


def stop_after_time(q: StreamingQuery, seconds: float) -> None:
    q.awaitTermination(int(seconds) if seconds >= 1 else 1)
    q.stop()


def rate_source(spark: SparkSession, hz: int) -> DataFrame:
    """value counts up at so many rows a second."""
    return spark.readStream.format("rate").option("rowsPerSecond", hz).load()


class Controlled:
    """A streaming query that can be paused: it stops, and resumes from its checkpoint without loss."""

    def __init__(self, stream: DataFrame, sink: Callable[[DataFrame, int], None], every: str = "0 seconds"):
        self.stream, self.sink, self.every = stream, sink, every
        self.state = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
        self.query: StreamingQuery | None = None

    def resume(self) -> None:
        if self.query is None or not self.query.isActive:
            self.query = self.stream.writeStream.foreachBatch(self.sink).option("checkpointLocation", self.state).trigger(processingTime=self.every).start()

    def sync(self) -> None:
        """Pause once all that is there has been handled."""
        if self.query is not None and self.query.isActive:
            self.query.processAllAvailable()
        self.pause()

    def pause(self) -> None:
        if self.query is not None:
            self.query.stop()


def configured(stream: DataFrame, settings: Callable[[], object], apply: Callable[[DataFrame, object], DataFrame], sink: Callable[[DataFrame, int], None], **options: str) -> StreamingQuery:
    """Each step under the settings that hold when it starts: a change applies from the next step on."""
    return stream.writeStream.foreachBatch(lambda df, n: sink(apply(df, settings()), n)).options(**options).start()
