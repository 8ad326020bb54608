"""Robust statistics of benchmark samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import metric_class, metric_score


def upper_median(values: Column) -> Column:
    """The upper of the middle two of an array."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def ranked_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Upper median of each group by rank, so that no group is collected."""
    by = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(by.orderBy(value))).withColumn("_n", F.count("*").over(by))
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(*keys, F.col(value).alias(name))


def median_of_means(df: DataFrame, keys: Sequence[str], value: str, order_by: str, k: int = 5) -> DataFrame:
    """Values dealt in turn to k buckets; the upper median of the buckets' means."""
    dealt = df.withColumn("_bucket", F.pmod(F.row_number().over(Window.partitionBy(*keys).orderBy(order_by)) - 1, F.lit(k)))
    means = dealt.groupBy(*keys, "_bucket").agg(F.avg(value).alias("_mean"))
    return means.groupBy(*keys).agg(upper_median(F.collect_list("_mean")).alias("median_of_means"))  # k values at most


def coef_var(value: str) -> Column:
    """Population deviation over the mean; 0 for one sample or a mean of 0."""
    return F.when((F.count(value) < 2) | (F.avg(value) == 0), 0.0).otherwise(F.stddev_pop(value) / F.avg(value))


def summarize_samples(df: DataFrame, keys: Sequence[str], seconds: str, count: int, order_by: str) -> DataFrame:
    us, rate = F.col(seconds) / count * 1e6, count / F.col(seconds)
    plain = df.groupBy(*keys).agg(
        F.count(seconds).alias("samples"), F.median(seconds).alias("seconds_median"), F.avg(seconds).alias("seconds_mean"), F.min(seconds).alias("seconds_min"), F.max(seconds).alias("seconds_max"),
        coef_var(seconds).alias("seconds_cv"), F.median(us).alias("us_per_message_median"), F.avg(us).alias("us_per_message_mean"), F.median(rate).alias("messages_per_second_median"), F.avg(rate).alias("messages_per_second_mean"),
    )
    return plain.join(median_of_means(df, keys, seconds, order_by).withColumnRenamed("median_of_means", "seconds_median_of_means"), list(keys))


def load_metrics(df: DataFrame, keys: Sequence[str], send: str, receive: str, counter: str, size: int) -> DataFrame:
    """Throughput and latency of received messages.

    Rates are over the span of send times.  Gaps between receive times leave
    out zeros; counter gaps are over all counters of a group in order.  One
    distinct send time gives null rates.
    """
    by = Window.partitionBy(*keys)
    gap = F.col(receive) - F.lag(receive).over(by.orderBy(receive, counter))
    jump = F.greatest(F.col(counter) - F.lag(counter).over(by.orderBy(counter, receive)) - 1, F.lit(0))
    rows = df.withColumn("_latency", F.col(receive) - F.col(send)).withColumn("_gap", gap).withColumn("_jump", jump)
    runtime = F.max(send) - F.min(send)
    plain = rows.groupBy(*keys).agg(
        F.count("*").alias("num_msgs"),
        F.try_divide(F.count("*").cast("double"), runtime).alias("sample_rate_mean"),
        F.try_divide(F.lit(1.0), F.median(F.when(F.col("_gap") != 0, F.col("_gap")))).alias("sample_rate_median"),
        (F.abs(F.sum("_latency")) / F.count("*")).alias("latency_mean"),
        F.abs(F.sum("_latency")).alias("latency_total"),
        F.try_divide(F.count("*") * F.lit(float(size)), runtime).alias("data_rate"),
        F.coalesce(F.sum("_jump"), F.lit(0)).cast("long").alias("dropped"),
    )
    return plain.join(ranked_median(rows, keys, "_latency", "latency_median"), list(keys))


def run_then_median(df: DataFrame, run: str, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean within a run, then median across runs."""
    runs = df.groupBy(run, *keys).agg(*[F.avg(m).alias(m) for m in metrics])
    return runs.groupBy(*keys).agg(*[F.median(m).alias(m) for m in metrics])


def relative(candidate: DataFrame, baseline: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Percent of the baseline, for cases that both have."""
    base = baseline.select(*keys, *[F.col(m).alias(f"_{m}") for m in metrics])
    out = candidate.join(base, list(keys)).select(*keys, *[F.try_divide(F.col(m) * 100.0, F.col(f"_{m}")).alias(m) for m in metrics])
    return out.dropna("all", subset=list(metrics))


def metric_deltas(rel: DataFrame, keys: Sequence[str], metrics: Sequence[str], band: float = 10.0) -> DataFrame:
    """A row for each case and metric: value, score and class."""
    long = rel.unpivot(list(keys), list(metrics), "metric", "value")
    return long.withColumn("score", metric_score(F.col("metric"), F.col("value"))).withColumn("class", metric_class(F.col("metric"), F.col("value"), band))


def top_deltas(deltas: DataFrame, which: str, keys: Sequence[str], n: int = 5) -> DataFrame:
    """The largest improvements or regressions; ties in the order of the keys."""
    order = F.desc("score") if which == "improvement" else F.asc("score")
    return deltas.where(F.col("class") == which).orderBy(order, *keys, "metric").limit(n)


def report_rows(candidate: DataFrame, baseline: DataFrame, rel: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Candidate, baseline and relative values side by side; severity is the largest score either way."""
    named = lambda df, tag: df.select(*keys, *[F.col(m).alias(f"{m}_{tag}") for m in metrics])
    out = named(candidate, "candidate").join(named(baseline, "baseline"), list(keys), "left").join(named(rel, "relative"), list(keys), "left")
    scores = [F.abs(metric_score(F.lit(m), F.col(f"{m}_relative"))) for m in metrics]
    return out.withColumn("severity", F.greatest(*scores) if len(scores) > 1 else scores[0])


def ab_summary(pairs: DataFrame, case: str, a: str, b: str) -> DataFrame:
    """Medians of both sides and of their paired differences in percent."""
    delta = (F.col(b) / F.col(a) - 1.0) * 100.0
    return pairs.groupBy(case).agg(
        F.median(a).alias("a_median"), F.median(b).alias("b_median"), F.median(delta).alias("delta_pct_median"), F.avg(delta).alias("delta_pct_mean"),
        F.count("*").alias("pair_count"), F.count_if(F.col(b) < F.col(a)).alias("b_faster_pairs"),
    )


def ab_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Values of both sides by round and case; a case that one side lacks is an error."""
    both = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), list(keys), "full")
    fits = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("both sides need the same cases")).cast("boolean"))
    return both.where(fits)


def environment_diff(a: DataFrame, b: DataFrame, key: str = "field", value: str = "value") -> DataFrame:
    """Fields that differ between two (field, value) tables, those of either side."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b")))


def axis_values(entries: DataFrame, axes: Sequence[str]) -> DataFrame:
    """axis and value: every value, as text, that entries have on each axis, in order."""
    pairs = F.array(*[F.struct(F.lit(k).alias("axis"), F.col(k).cast("string").alias("value")) for k in axes])
    return entries.select(F.explode(pairs).alias("x")).select("x.*").distinct().orderBy("axis", "value")
