"""Benchmark analytics on lineitem: flag, status and line number are a case, ship months its runs, order parity the side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import stats
from weftline.session import table

KEYS = ["config", "comms", "n_clients"]
METRICS = ["sample_rate_mean", "latency_mean"]
BAND = 2.0


def entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("config"), F.col("l_linestatus").alias("comms"), F.col("l_linenumber").cast("int").alias("n_clients"),
        F.date_format("l_shipdate", "yyyy-MM").alias("run"), F.pmod("l_orderkey", F.lit(2)).cast("int").alias("side"),
        F.col("l_quantity").alias("sample_rate_mean"), F.col("l_extendedprice").alias("latency_mean"),
    )


ENTRIES = """entries as (select l_returnflag as config, l_linestatus as comms, l_linenumber::integer as n_clients, strftime(l_shipdate, '%Y-%m') as run,
    (l_orderkey % 2)::integer as side, l_quantity as sample_rate_mean, l_extendedprice as latency_mean from lineitem)"""
PIVOT = f"""{ENTRIES}, runs as (select side, run, config, comms, n_clients, avg(sample_rate_mean) as a, avg(latency_mean) as b from entries group by all),
pivoted as (select side, config, comms, n_clients, median(a) as sample_rate_mean, median(b) as latency_mean from runs group by all)"""
REL = f"""{PIVOT}, rel as (select c.config, c.comms, c.n_clients, c.sample_rate_mean * 100.0 / b.sample_rate_mean as sample_rate_mean, c.latency_mean * 100.0 / b.latency_mean as latency_mean
    from pivoted c join pivoted b using (config, comms, n_clients) where c.side = 1 and b.side = 0)"""
DELTAS = f"""{REL}, deltas as (select config, comms, n_clients, metric, value, case when metric = 'latency_mean' then 100.0 - value else value - 100.0 end as score
    from rel unpivot (value for metric in (sample_rate_mean, latency_mean))),
classed as (select *, case when abs(score) <= {BAND} then 'neutral' when score > 0 then 'improvement' else 'regression' end as class from deltas)"""


def _pivot(spark: SparkSession, d: str) -> DataFrame:
    return stats.run_then_median(entries(spark, d), "run", ["side", *KEYS], METRICS)


def _relative(spark: SparkSession, d: str) -> DataFrame:
    p = _pivot(spark, d)
    return stats.relative(p.where("side = 1"), p.where("side = 0"), KEYS, METRICS)


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    return stats.metric_deltas(_relative(spark, d), KEYS, METRICS, BAND)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else c for c, kind in df.dtypes])


def perf_pivot(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_pivot(spark, d))


def perf_relative(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_relative(spark, d))


def perf_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return _deltas(spark, d).groupBy("metric", "class").agg(F.count("*").alias("n"))


def perf_top_regressions(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.top_deltas(_deltas(spark, d), "regression", KEYS))


def perf_top_improvements(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.top_deltas(_deltas(spark, d), "improvement", KEYS))


def perf_report_rows(spark: SparkSession, d: str) -> DataFrame:
    p = _pivot(spark, d)
    return _rounded(stats.report_rows(p.where("side = 1"), p.where("side = 0"), _relative(spark, d), KEYS, METRICS))


def perf_axis_values(spark: SparkSession, d: str) -> DataFrame:
    return stats.axis_values(entries(spark, d), KEYS)


def perf_formatted(spark: SparkSession, d: str) -> DataFrame:
    x = _deltas(spark, d)
    value = F.round("value", 6)
    return x.select(*KEYS, "metric", text.formatted(F.col("metric"), value, True).alias("shown"), F.round(text.comparison_alpha(F.col("score"), BAND), 6).alias("alpha"))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", (F.col("value") + 1.0).alias("seconds"))


def median_of_means(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.median_of_means(_samples(spark, d), ["user_id"], "seconds", "event_id"))


def coef_var(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_samples(spark, d).groupBy("user_id").agg(stats.coef_var("seconds").alias("cv")))


def hotpath_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.summarize_samples(_samples(spark, d), ["user_id"], "seconds", 100, "event_id"), 4)


def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.ranked_median(_samples(spark, d), ["user_id"], "seconds", "upper_median"))


def load_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per event type: send times in whole seconds, received value milliseconds later."""
    e = table(spark, d, "events")
    send = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = e.select("event_type", "event_id", send.alias("send_ts"), (send + F.col("value") / 1000.0).alias("recv_ts"))
    return _rounded(stats.load_metrics(rows, ["event_type"], "send_ts", "recv_ts", "event_id", 64), 3)


def _rounds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = entries(spark, d).select(F.concat_ws("/", "config", "comms").alias("case_id"), "run", "side", "latency_mean")
    p = e.groupBy("case_id", "run", "side").agg(F.avg("latency_mean").alias("us"))
    one, two = p.where("side = 0"), p.where("side = 1")
    both = one.select("case_id", "run").intersect(two.select("case_id", "run"))
    return one.join(both, ["case_id", "run"], "left_semi"), two.join(both, ["case_id", "run"], "left_semi")


def ab_summary(spark: SparkSession, d: str) -> DataFrame:
    a, b = _rounds(spark, d)
    s = stats.ab_summary(stats.ab_pairs(a, b, ["case_id", "run"], "us"), "case_id", "a", "b")
    return _rounded(s.withColumn("verdict", text.ab_verdict(F.col("delta_pct_median"))))


AB = f"""with {ENTRIES}, p as (select config || '/' || comms as case_id, run, side, avg(latency_mean) as us from entries group by all),
pairs as (select a.case_id, a.us as a, b.us as b from p a join p b using (case_id, run) where a.side = 0 and b.side = 1),
s as (select case_id, median(a) as a_median, median(b) as b_median, median((b / a - 1.0) * 100.0) as delta_pct_median, avg((b / a - 1.0) * 100.0) as delta_pct_mean, count(*) as pair_count, count(*) filter (b < a) as b_faster_pairs from pairs group by all)
select case_id, round(a_median, 6) as a_median, round(b_median, 6) as b_median, round(delta_pct_median, 6) as delta_pct_median, round(delta_pct_mean, 6) as delta_pct_mean, pair_count, b_faster_pairs,
    case when delta_pct_median > 0 then 'regression' else 'improvement' end as verdict from s"""


def env_diff(spark: SparkSession, d: str) -> DataFrame:
    """Nations as fields: their region in a, and in b with every fifth changed and every seventh gone."""
    n = table(spark, d, "nation")
    a = n.select(F.col("n_name").alias("field"), F.col("n_regionkey").cast("string").alias("value"))
    b = n.where("n_nationkey % 7 <> 0").select(F.col("n_name").alias("field"), F.when(F.col("n_nationkey") % 5 == 0, "new").otherwise(F.col("n_regionkey").cast("string")).alias("value"))
    return stats.environment_diff(a, b)


def bench_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every combination of parameters, by case id.  Both sides are fixed lists of the grid."""
    r = table(spark, d, "region").select("r_name")
    sizes = spark.createDataFrame([(64,), (4096,)], "payload int")
    return r.join(sizes, F.lit(True)).select(text.case_id(F.lit("async"), F.lower("r_name"), F.col("payload"), F.lit(32)).alias("case_id")).orderBy("case_id")


M = "sample_rate_mean", "latency_mean"
QUERIES = {f.__name__: f for f in (perf_pivot, perf_relative, perf_class_counts, perf_top_regressions, perf_top_improvements, perf_report_rows, perf_axis_values, perf_formatted, median_of_means, coef_var, hotpath_summary, upper_median, load_metrics, ab_summary, env_diff, bench_grid)}
_SAMPLES = "s as (select user_id, event_id, value + 1.0 as seconds from events)"
_MOM = f"""{_SAMPLES}, b as (select user_id, seconds, (row_number() over (partition by user_id order by event_id) - 1) % 5 as k from s),
m as (select user_id, k, avg(seconds) as mean from b group by all), mom as (select user_id, list_sort(list(mean))[(count(*) // 2 + 1)::bigint] as median_of_means from m group by all)"""
SQL = {
    "perf_pivot": f"with {PIVOT} select side, config, comms, n_clients, round(sample_rate_mean, 6) as sample_rate_mean, round(latency_mean, 6) as latency_mean from pivoted",
    "perf_relative": f"with {REL} select config, comms, n_clients, round(sample_rate_mean, 6) as sample_rate_mean, round(latency_mean, 6) as latency_mean from rel",
    "perf_class_counts": f"with {DELTAS} select metric, class, count(*) as n from classed group by all",
    "perf_top_regressions": f"with {DELTAS} select config, comms, n_clients, metric, round(value, 6) as value, round(score, 6) as score, class from (select * from classed where class = 'regression' order by score, config, comms, n_clients, metric limit 5)",
    "perf_top_improvements": f"with {DELTAS} select config, comms, n_clients, metric, round(value, 6) as value, round(score, 6) as score, class from (select * from classed where class = 'improvement' order by score desc, config, comms, n_clients, metric limit 5)",
    "perf_report_rows": f"""with {REL} select config, comms, n_clients, {', '.join(f'round({t}.{m}, 6) as {m}_{n}' for t, n in (('c', 'candidate'), ('b', 'baseline'), ('r', 'relative')) for m in M)},
        round(greatest(abs(r.sample_rate_mean - 100.0), abs(100.0 - r.latency_mean)), 6) as severity
        from (select * from pivoted where side = 1) c left join (select * from pivoted where side = 0) b using (config, comms, n_clients) left join rel r using (config, comms, n_clients)""",
    "perf_axis_values": f"with {ENTRIES} select distinct axis, value from (select config, comms, n_clients::varchar as n_clients from entries) unpivot (value for axis in (config, comms, n_clients))",
    "perf_formatted": f"with {DELTAS} select config, comms, n_clients, metric, printf('%.1f', round(value, 6)) || '%' as shown, round(0.15 + 0.35 * least(1.0, greatest(0.0, (abs(score) - {BAND}) / 45.0)), 6) as alpha from classed",
    "median_of_means": f"with {_MOM} select user_id, round(median_of_means, 6) as median_of_means from mom",
    "coef_var": f"with {_SAMPLES} select user_id, round(case when count(*) < 2 or avg(seconds) = 0 then 0 else stddev_pop(seconds) / avg(seconds) end, 6) as cv from s group by user_id",
    "hotpath_summary": f"""with {_MOM} select user_id, count(*) as samples, round(median(seconds), 4) as seconds_median, round(avg(seconds), 4) as seconds_mean, round(min(seconds), 4) as seconds_min, round(max(seconds), 4) as seconds_max,
        round(case when count(*) < 2 or avg(seconds) = 0 then 0 else stddev_pop(seconds) / avg(seconds) end, 4) as seconds_cv, round(median(seconds / 100 * 1e6), 4) as us_per_message_median, round(avg(seconds / 100 * 1e6), 4) as us_per_message_mean,
        round(median(100 / seconds), 4) as messages_per_second_median, round(avg(100 / seconds), 4) as messages_per_second_mean, round(any_value(median_of_means), 4) as seconds_median_of_means
        from s join mom using (user_id) group by user_id""",
    "upper_median": f"with {_SAMPLES} select user_id, round(list_sort(list(seconds))[(count(*) // 2 + 1)::bigint], 6) as upper_median from s group by user_id",
    "load_metrics": """with r as (select event_type, event_id, epoch_us(ts) / 1e6 as s, epoch_us(ts) / 1e6 + value / 1000.0 as t from events),
        g as (select *, t - s as lat, t - lag(t) over (partition by event_type order by t, event_id) as gap, greatest(event_id - lag(event_id) over (partition by event_type order by event_id, t) - 1, 0) as jump from r)
        select event_type, count(*) as num_msgs, round(count(*) / (max(s) - min(s)), 3) as sample_rate_mean, round(1.0 / median(case when gap <> 0 then gap end), 3) as sample_rate_median,
        round(abs(sum(lat)) / count(*), 3) as latency_mean, round(abs(sum(lat)), 3) as latency_total, round(count(*) * 64.0::double / (max(s) - min(s)), 3) as data_rate, coalesce(sum(jump), 0)::bigint as dropped,
        round(list_sort(list(lat))[(count(*) // 2 + 1)::bigint], 3) as latency_median from g group by event_type""",
    "ab_summary": AB,
    "env_diff": """with a as (select n_name as field, n_regionkey::varchar as value from nation), b as (select n_name as field, case when n_nationkey % 5 = 0 then 'new' else n_regionkey::varchar end as value from nation where n_nationkey % 7 <> 0)
        select field, a.value as a, b.value as b from a full join b using (field) where a.value is distinct from b.value""",
    "bench_grid": "select 'async/' || lower(r_name) || '/payload=' || p || '/buffers=32' as case_id from region, (values (64), (4096)) x(p)",
}
