"""Counters, rates and traces of running endpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def publish_delta(df: DataFrame, every: int, ts: str, order_by: str, keys: Sequence[str]) -> DataFrame:
    """Every n-th message with the time since the one sampled before it; 0 for the first."""
    by = Window.partitionBy(*keys).orderBy(order_by)
    sampled = df.withColumn("_n", F.row_number().over(by)).where(F.col("_n") % every == 0).drop("_n")
    return sampled.withColumn("delta", F.coalesce(F.col(ts) - F.lag(ts).over(by), F.lit(0.0)))


def receive_gaps(df: DataFrame, ts: str, keys: Sequence[str], order_by: str) -> DataFrame:
    """df plus gap to the receive time before; null for the first."""
    return df.withColumn("gap", F.col(ts) - F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts, order_by)))


def counter_gaps(df: DataFrame, counter: str, keys: Sequence[str], order_by: str) -> DataFrame:
    """Messages whose counter is not the previous one plus 1, and how many are missing; counters start at 0."""
    by = Window.partitionBy(*keys).orderBy(order_by)
    out = df.withColumn("expected", F.lag(counter, 1, -1).over(by) + 1)
    return out.where(F.col(counter) != F.col("expected")).withColumn("missing", F.greatest(F.col(counter) - F.col("expected"), F.lit(0)))


def snapshots(totals: DataFrame, total: str, ts: str, keys: Sequence[str]) -> DataFrame:
    """Totals at snapshot times plus window and rate since the one before; the first window is 0."""
    by = Window.partitionBy(*keys).orderBy(ts)
    window = F.col(total) - F.coalesce(F.lag(total).over(by), F.col(total))
    out = totals.withColumn("window", window).withColumn("_span", F.col(ts) - F.lag(ts).over(by))
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("window").cast("double"), F.col("_span")), F.lit(0.0))).drop("_span")


def running_totals(df: DataFrame, at: str, keys: Sequence[str]) -> DataFrame:
    """Messages up to each time of `at`, one row for each time that has any."""
    counts = df.groupBy(*keys, at).agg(F.count("*").alias("_n"))
    return counts.withColumn("total", F.sum("_n").over(Window.partitionBy(*keys).orderBy(at))).drop("_n")


def trace_scope(samples: DataFrame, topics: Sequence[str] = (), endpoints: Sequence[str] = (), metrics: Sequence[str] | None = None) -> DataFrame:
    """Empty topics or endpoints restrict nothing; metrics of None neither, but no metrics at all select none."""
    if topics:
        samples = samples.where(F.col("topic").isin(*topics))
    if endpoints:
        samples = samples.where(F.col("endpoint_id").isin(*endpoints))
    if metrics is not None:
        samples = samples.where(F.col("metric").isin(*metrics) if metrics else F.lit(False))
    return samples


def trace_merge(queues: Sequence[DataFrame], most: int = 1000) -> DataFrame:
    """The first samples of several queues by time, then number, then queue; no number counts as -1."""
    out = None
    for i, q in enumerate(queues):
        q = q.withColumn("queue", F.lit(i))
        out = q if out is None else out.unionByName(q)
    assert out is not None
    return out.orderBy("timestamp", F.coalesce("sample_seq", F.lit(-1)), "queue").limit(most)


def drop_summary(df: DataFrame, counter: str, latency: str, keys: Sequence[str]) -> DataFrame:
    """Received, dropped out of the expected number, and mean latency."""
    expected = F.max(counter) - F.min(counter) + 1
    return df.groupBy(*keys).agg(F.count("*").alias("received"), (expected - F.count("*")).alias("dropped"), F.avg(latency).alias("latency_mean"))


def ranked_view(endpoints: DataFrame, rate: str, total: str, rest: Sequence[str], most: int) -> DataFrame:
    """The busiest endpoints: by rate, then total, both falling, then names."""
    return endpoints.orderBy(F.desc(rate), F.desc(total), *rest).limit(most)


def receiver_totals(df: DataFrame, channel: str, order_by: str, keys: Sequence[str]) -> DataFrame:
    """Messages each receiver has got, and the channel of the last one."""
    return df.groupBy(*keys).agg(F.count("*").alias("received_total"), F.max_by(channel, order_by).alias("last_channel"))
