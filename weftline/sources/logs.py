"""Message logs, benchmark logs, and sinks for them."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.functions.codec import START, log_fields, log_line
from weftline.session import cut


def message_log(spark: SparkSession, path: str, schema: str = "string") -> DataFrame:
    """ts and obj of each line of JSON logs; start markers and lines that are no JSON are left out."""
    lines = spark.read.text(path)
    return parse_log(lines, schema)


def parse_log(lines: DataFrame, schema: str = "string") -> DataFrame:
    parsed = lines.where(~F.col("value").contains(START)).select(log_fields(F.col("value"), schema).alias("x"))
    return parsed.where("x.ts is not null").select("x.ts", "x.obj")


def write_log(messages: DataFrame, path: str, ts: str = "ts", obj: str = "obj", mode: str = "overwrite") -> None:
    """Messages as JSON lines."""
    messages.select(log_line(F.col(ts), F.col(obj)).alias("value")).write.mode(mode).text(path)


class MessageLogger:
    """Logs messages to every open path and passes them on.

    open() truncates a path and writes the start marker; a path that is open
    already stays as it is.  log() serves batches and, as the function of
    foreachBatch, streams.  With a write period, batches are kept in the shared
    folder and written together once it has passed, and at flush() or close().
    """

    def __init__(self, path: str | None = None, write_period: float = 0.0, clock: Callable[[], float] = time.time) -> None:
        self.paths: list[str] = []
        self.first, self.write_period, self.clock = path, write_period, clock
        self.kept: list[DataFrame] = []
        self.since = clock()

    def open(self, spark: SparkSession, path: str) -> str | None:
        """The path if it is now open and was not."""
        if path in self.paths:
            return None
        marker = spark.range(1).select(log_line(F.unix_micros(F.current_timestamp()) / 1e6, F.lit(START)).alias("value"))
        marker.write.mode("overwrite").text(path)
        self.paths.append(path)
        return path

    def close(self, path: str) -> str | None:
        """The path if it was open; what is kept is written first."""
        if path not in self.paths:
            return None
        self.flush()
        self.paths.remove(path)
        return path

    def log(self, messages: DataFrame, batch_id: int | None = None) -> DataFrame:
        """messages (ts, obj), unchanged."""
        if self.first is not None:
            self.open(messages.sparkSession, self.first)
            self.first = None
        lines = messages.select(log_line(F.col("ts"), F.col("obj")).alias("value"))
        if self.write_period <= 0:
            self.write(lines)
        else:
            self.kept.append(cut(lines))
            if self.clock() - self.since >= self.write_period:
                self.flush()
        return messages

    def write(self, lines: DataFrame) -> None:
        for path in self.paths:
            lines.write.mode("append").text(path)

    def flush(self) -> None:
        if self.kept:
            self.write(functools.reduce(DataFrame.unionByName, self.kept))
        self.kept, self.since = [], self.clock()


def perf_runs(lines: DataFrame, entry_schema: str, order_by: str = "line_no") -> DataFrame:
    """Entries (value) with run_idx: each environment line but the first begins the next run.

    Lines are dealt by ranges of their order and counted in each; the counts
    of the ranges before are added, so no task takes a whole log.  Logs
    (column file) are apart where they are several.
    """
    keys = ["file"] if "file" in lines.columns else []
    env = F.get_json_object("value", "$.env").isNotNull().cast("int")
    dealt = cut(lines.withColumn("_env", env).repartitionByRange(*keys, order_by).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*keys, "_part").agg(F.sum("_env").alias("_n"))  # a row for each range
    parts = parts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = F.sum("_env").over(Window.partitionBy(*keys, "_part").orderBy(order_by).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("_part") == F.col("_of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    numbered = dealt.withColumn("_here", here).where("_env = 0").join(parts, same)
    numbered = numbered.withColumn("run_idx", F.greatest(F.col("_before") + F.col("_here") - 1, F.lit(0)))
    return numbered.select(*keys, "run_idx", F.from_json("value", entry_schema).alias("e")).select(*keys, "run_idx", "e.*")


def case_medians(spark: SparkSession, path: str) -> DataFrame:
    """case_id and median microseconds of a summary file's results."""
    read = spark.read.json(path, schema="results array<struct<case_id:string,us_per_message_median:double>>", multiLine=True)
    return read.select(F.explode("results").alias("r")).select("r.case_id", "r.us_per_message_median")


def write_trace_csv(trace: DataFrame, path: str) -> None:
    """Time,Source,Topic,SampleTime,PerfCounter,Elapsed"""
    trace.select("Time", "Source", "Topic", "SampleTime", "PerfCounter", "Elapsed").write.mode("overwrite").csv(path, header=True)


def counter_source(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "value")


def load_source(spark: SparkSession, n: int, size: int, key: str) -> DataFrame:
    """Messages of a load test: counter, send time and a payload of zeros."""
    return spark.range(n).select(F.lit(key).alias("key"), F.col("id").alias("counter"), F.current_timestamp().cast("double").alias("send_ts"), F.repeat(F.lit("\0"), size).cast("binary").alias("payload"))


def oscillator(spark: SparkSession, n: int, rate: float, frequency: float) -> DataFrame:
    """A sine at an update rate."""
    at = F.col("id") / rate
    return spark.range(n).select(at.alias("t"), F.sin(2 * 3.141592653589793 * frequency * at).alias("value"))


def stream_files(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1, kind: str = "parquet") -> DataFrame:
    """A stream of a folder's files, so many in each step."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def write_results(results: DataFrame, path: str) -> None:
    """Result rows as JSON documents."""
    results.write.mode("overwrite").json(path)
