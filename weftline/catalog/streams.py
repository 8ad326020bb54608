"""Streaming operators on events, drained into batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import messages as m
from weftline.plans.pipeline import Pipeline, unit
from weftline.sources.logs import stream_files
from weftline.session import table
from weftline.streaming import stream as s


#: More files than a table has: they come in one step, so that none is late and a whole result is written once.
ALL = (1 << 31) - 1


def _stream(spark: SparkSession, d: str, files: int = 1) -> DataFrame:
    schema = table(spark, d, "events").schema
    return stream_files(spark, f"{d}/events.parque[t]", schema, files)  # a pattern, as the table may be one file


def stream_filter(spark, d):
    return s.drain(_stream(spark, d).where("user_id = 7").select("event_id", "event_type", "value"))


def stream_union(spark, d):
    x = _stream(spark, d).select("event_id", "event_type")
    return s.drain(x.where("event_type = 'click'").unionByName(x.where("event_type = 'view'")))


def stream_gate(spark, d):
    x = _stream(spark, d).select("user_id", "event_id")
    return s.drain(s.gate(x, "user_id", "event_id", start_open=True, default_after=3), started_with=s.GATE_SETTINGS)


def stream_tumbling(spark, d):
    """Windows of a day, whatever the order of the files; the last ones are still open at the end and stay out."""
    x = s.drain(s.tumbling_counts(_stream(spark, d, ALL), "ts", "1 day", "0 seconds"))
    return x.select(F.unix_seconds("start").alias("start"), "n", F.round("total", 6).alias("total"))


def stream_sessions(spark, d):
    """Sessions of every user, those still open at the end too."""
    x = s.drain(s.sessions(_stream(spark, d, ALL), "ts", "2 hours", None, ["user_id"]), "complete")
    return x.select(F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("end"), "user_id", "n")


def pipeline_graph(spark, d):
    """A source, a key filter and a counter, wired by topics with a diamond in between: each message counts once."""
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("key"))
    parts = {"FILTER": unit(lambda INPUT: m.filter_key(INPUT, "click")), "COUNT": unit(lambda INPUT: INPUT.agg(F.count("*").alias("n")))}
    wired = Pipeline(parts, [("EVENTS", "LEFT"), ("EVENTS", "RIGHT"), ("LEFT", "FILTER/INPUT"), ("RIGHT", "FILTER/INPUT"), ("FILTER/OUTPUT", "COUNT/INPUT")])
    return wired.streams({"EVENTS": e})["COUNT/OUTPUT"]


QUERIES = {f.__name__: f for f in (stream_filter, stream_union, stream_gate, stream_tumbling, stream_sessions, pipeline_graph)}
SQL = {
    "stream_filter": "select event_id, event_type, value from events where user_id = 7",
    "stream_union": "select event_id, event_type from events where event_type in ('click', 'view')",
    "stream_gate": "select user_id, event_id from events qualify row_number() over (partition by user_id order by event_id) <= 3",
    "stream_tumbling": """select epoch(date_trunc('day', ts))::bigint as start, count(*) as n, round(sum(value), 6) as total from events
        group by 1 having max(date_trunc('day', ts)) + interval 1 day <= (select max(ts) from events)""",
    "stream_sessions": """with e as (select user_id, ts, ts >= lag(ts) over w + interval 2 hours or lag(ts) over w is null as new from events window w as (partition by user_id order by ts)),
        s as (select user_id, ts, sum(new::integer) over (partition by user_id order by ts rows unbounded preceding) as k from e)
        select epoch(date_trunc('second', min(ts)))::bigint as start, epoch(date_trunc('second', max(ts) + interval 2 hours))::bigint as "end", user_id, count(*) as n from s group by user_id, k""",
    "pipeline_graph": "select count(*) as n from events where event_type = 'click'",
}
