"""Message operators on events: topic is the event type, key the user, order the event id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import codec, text
from weftline.operators import messages as m
from weftline.operators import telemetry as t
from weftline.plans import control
from weftline.session import table
from weftline.sources import logs


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("topic"), "value")


def _timed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("topic"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("double").alias("sec"))


def filter_key(spark, d):
    return m.filter_key(_events(spark, d), "7")


def set_key(spark, d):
    return m.set_key(_events(spark, d), "new key")


def fan_in(spark, d):
    e = _events(spark, d)
    return m.fan_in(m.filter_key(e, "7"), m.filter_key(e, "7"), m.filter_key(e, "8"))


def modulus(spark, d):
    return m.modulus(_events(spark, d).select("event_id", (F.col("event_id") - 500).alias("v")), "v", 3, "m").select("event_id", "m")


def chunk_events(spark, d):
    c = m_chunks(spark, d)
    return c.groupBy("chunk").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.min("event_id").alias("first_id"))


def m_chunks(spark, d):
    from weftline.operators.arrays import chunk_rows

    return chunk_rows(table(spark, d, "events").select("event_id", "value"), "event_id", 19, dense=True)


def chunk_by_user(spark, d):
    from weftline.operators.arrays import chunk_rows

    c = chunk_rows(_events(spark, d), "event_id", 4, ["key"])
    return c.groupBy("key", "chunk").agg(F.count("*").alias("n"), F.max("place").alias("last_place"), F.min("event_id").alias("first_id"))


def _controls(spark, d):
    return _events(spark, d).where("topic in ('purchase', 'error')").select("key", "event_id", (F.col("topic") == "purchase").alias("open"))


def gate_control(spark, d):
    e = _events(spark, d)
    return m.gate(e.where("topic not in ('purchase', 'error')"), _controls(spark, d), "event_id", ["key"]).select("key", "event_id")


def gate_after_n(spark, d):
    return m.gate_first(_events(spark, d), 3, "event_id", ["key"]).select("key", "event_id")


def gate_reverting(spark, d):
    """Opened by purchases; falls closed again after two messages."""
    e = _events(spark, d)
    c = _controls(spark, d).where("open")
    return m.gate_reverting(e.where("topic not in ('purchase', 'error')"), c, "event_id", ["key"], default_after=2).select("key", "event_id")


def leaky_last_n(spark, d):
    return m.newest(_events(spark, d), 3, "event_id", ["key"]).select("key", "event_id")


def retention(spark, d):
    return m.newest(_events(spark, d), 1000, "event_id").select("event_id", "key")


def cursor_after(spark, d):
    e = _events(spark, d).withColumnRenamed("event_id", "seq")
    return m.after(e, 100, retained=500).select("seq", "key")


def sample_hold(spark, d):
    e = _events(spark, d).withColumn("number", F.when(F.col("topic") == "purchase", F.col("value")))
    return m.hold(e, "number", "event_id", ["key"], 0.0).select("event_id", F.round("held", 6).alias("held"))


def trace_sample(spark, d):
    return m.every_nth(_events(spark, d), 3, "event_id", ["key"]).select("event_id", "key")


def listener_latest(spark, d):
    return m.latest(_events(spark, d), "value", "event_id", ["key"])


def terminate_total(spark, d):
    return m.until_total(_events(spark, d), 25, "event_id").select("event_id")


def publish_delta(spark, d):
    return t.publish_delta(_timed(spark, d), 3, "sec", "event_id", ["key"]).select("event_id", "delta")


def receive_gaps(spark, d):
    return t.receive_gaps(_timed(spark, d), "sec", ["topic"], "event_id").select("event_id", "gap")


def counter_gaps(spark, d):
    e = _events(spark, d).withColumn("counter", F.floor(F.col("event_id") / 2))
    return t.counter_gaps(e, "counter", ["key"], "event_id").select("event_id", "expected", "missing")


def _snapshots(spark, d):
    e = _timed(spark, d).withColumn("at", F.floor(F.col("sec") / 86400) * 86400.0)
    return t.running_totals(e, "at", ["key"])


def pub_snapshot(spark, d):
    return t.snapshots(_snapshots(spark, d), "total", "at", ["key"]).select("key", "at", "total", "window", F.round("rate", 9).alias("rate"))


def sub_snapshot(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return t.receiver_totals(e, "event_type", "event_id", ["user_id"])


def trace_merge(spark, d):
    x = _timed(spark, d).select(F.col("sec").alias("timestamp"), F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("event_id")).alias("sample_seq"), "topic", "event_id")
    return t.trace_merge([x.where("topic = 'click'"), x.where("topic = 'view'")], 100).select("timestamp", "queue")


def trace_scope(spark, d):
    e = _events(spark, d).select("event_id", "topic", F.col("key").alias("endpoint_id"), F.lit("lease").alias("metric"))
    return t.trace_scope(e, ["click", "view"], ["1", "2", "3", "4"], None)


def trace_windows(spark, d):
    """Purchases of a user switch tracing on for an hour."""
    x = _timed(spark, d).select("event_id", F.col("key").alias("endpoint_id"), F.col("sec").alias("timestamp"), "topic")
    c = x.where("topic = 'purchase'").groupBy("endpoint_id", F.col("timestamp").alias("at")).agg(F.lit(3600.0).alias("ttl"))
    return control.trace_windows(x.where("topic <> 'purchase'").select("event_id", "endpoint_id", "timestamp"), c)


def drop_summary(spark, d):
    return t.drop_summary(_events(spark, d), "event_id", "value", ["topic"]).withColumn("latency_mean", F.round("latency_mean", 6))


def telemetry_view(spark, d):
    e = _timed(spark, d).groupBy("topic", "key").agg(F.count("*").alias("total"), (F.max("sec") - F.min("sec")).alias("span"))
    e = e.withColumn("rate", F.round(F.coalesce(F.try_divide(F.col("total"), F.col("span")), F.lit(0.0)), 9))
    return t.ranked_view(e.drop("span"), "rate", "total", ["topic", "key"], 20)


def log_encode(spark, d):
    """Lines as they are written, read back."""
    e = table(spark, d, "events")
    lines = e.select(codec.log_line(F.col("event_id"), F.col("props")).alias("value"))
    return logs.parse_log(lines).select(F.col("ts").cast("long").alias("event_id"), F.get_json_object("obj", "$.k").cast("long").alias("k"))


def log_scan(spark, d):
    e = table(spark, d, "events")
    lines = e.select(F.when(F.col("event_id") % 10 == 0, F.lit('{"ts": 0, "obj": "__start__"}')).when(F.col("event_id") % 10 == 1, F.lit("no json {")).otherwise(codec.log_line(F.col("event_id"), F.from_json("props", "k long"))).alias("value"))
    return logs.parse_log(lines, "struct<k:long>").select(F.col("ts").cast("long").alias("event_id"), "obj.k")


def perf_runs(spark, d):
    """Every hundredth line is an environment."""
    e = table(spark, d, "events")
    lines = e.select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 100 == 0, F.lit('{"env": {"python": "3"}}')).otherwise(F.col("props")).alias("value"))
    return logs.perf_runs(lines, "k long").groupBy("run_idx").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


def array_codec(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("data"))
    back = e.select("vec_id", "data", codec.decoded_array(codec.encoded_array(F.col("data"))).alias("back"))
    return back.select("vec_id", (F.col("data") == F.col("back")).alias("same"), F.size("back").alias("n"))


def ndarray_codec(spark, d):
    """Arrays of four dtypes with their shapes through log lines and back."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x * 50).cast("double")).alias("data"))
    kinds = ["<f8", "<f4", "<i2", ">i4"]
    lines = None
    for i, kind in enumerate(kinds):
        one = e.where(F.col("vec_id") % 4 == i).select("vec_id", "data", codec.log_line(F.col("vec_id"), codec.encoded_ndarray(F.col("data"), F.array(F.lit(4), F.lit(16)), kind)).alias("line"))
        lines = one if lines is None else lines.unionByName(one)
    back = lines.select("vec_id", "data", codec.decoded_ndarray(codec.log_fields(F.col("line"), f"struct<{codec.ARRAY_FIELDS}>")["obj"]).alias("x"))
    return back.select("vec_id", (F.col("data") == F.col("x.data")).alias("same"), F.col("x.dtype").alias("dtype"), F.array_join("x.shape", "x").alias("shape"))


def _settings(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "exit").when(F.col("event_type") == "login", "initial").otherwise("update")
    return e.select(F.concat(F.lit("SYSTEM/U"), F.col("user_id")).alias("address"), F.col("event_id").alias("seq"), kind.alias("kind"), F.round("value", 3).alias("value"))


def settings_latest(spark, d):
    return control.current_settings(_settings(spark, d))


def settings_effective(spark, d):
    return control.effective_settings(_settings(spark, d))


def settings_accepted(spark, d):
    return control.accepted_updates(_settings(spark, d)).select("address", "seq")


def settings_patch(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.struct(F.struct(F.col("s_acctbal").alias("gain"), F.col("s_nationkey").alias("ch")).alias("filter"), F.col("s_name").alias("name")).alias("settings"))
    s = s.withColumn("settings", codec.with_setting(F.col("settings"), "filter.gain", F.lit(1.5)))
    return s.select("s_suppkey", F.to_json("settings").alias("settings"))


def settings_merge(spark, d):
    n = table(spark, d, "nation")
    base = F.create_map(F.lit("a"), F.col("n_nationkey"), F.lit("b"), F.col("n_regionkey"))
    x = n.select("n_nationkey", codec.merged(base, F.create_map(F.lit("b"), F.lit(9), F.lit("c"), F.lit(7))).alias("s"))
    return x.select("n_nationkey", F.col("s")["a"].alias("a"), F.col("s")["b"].alias("b"), F.col("s")["c"].alias("c"))


def text_functions(spark, d):
    p = table(spark, d, "part")
    n = F.col("p_partkey")
    return p.select(
        "p_partkey", text.address(F.lit("SYS"), "p_brand", "p_name").alias("address"), text.parent(text.address(F.lit("SYS"), "p_brand", "p_name")).alias("parent"),
        text.escape_html(F.concat(F.lit("<b a='"), "p_type", F.lit("'>&\""))).alias("html"), text.duration(n * 977).alias("duration"),
        text.truncated(F.col("p_name"), 8).alias("cut"), text.debug_line("dbg", F.col("p_name"), 5).alias("debug"),
        text.report_path(F.concat(F.lit("out/"), F.col("p_brand"), F.lit(".jsonl")), ".html", F.lit("x/base.jsonl")).alias("report"),
        text.assignments(F.concat(F.lit("A=1 B="), F.col("p_size").cast("string"), F.lit(" A=x=y")))["A"].alias("a"),
        text.type_parts(F.concat(F.lit("mod."), F.col("p_brand"), F.lit(":Cls")))["qualname"].alias("qualname"),
        text.widget(F.when(n % 2 == 0, "int").otherwise("float"), F.lit(None).cast("array<string>"), F.when(n % 3 == 0, 0), F.when(n % 3 == 0, 1)).alias("widget"),
    )


def datestamp(spark, d):
    return table(spark, d, "events").select("event_id", text.datestamp(F.col("ts")).alias("stamp"))


def component_tree(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("R"), F.col("n_regionkey"), F.lit("/N"), F.col("n_nationkey")).alias("address"))
    r = table(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("address"))
    return control.component_tree(r.unionByName(n))


_FNS = (filter_key, set_key, fan_in, modulus, chunk_events, chunk_by_user, gate_control, gate_after_n, gate_reverting, leaky_last_n, retention, cursor_after, sample_hold, trace_sample, listener_latest, terminate_total, publish_delta, receive_gaps, counter_gaps, pub_snapshot, sub_snapshot, trace_merge, trace_scope, trace_windows, drop_summary, telemetry_view, log_encode, log_scan, perf_runs, array_codec, ndarray_codec, settings_latest, settings_effective, settings_accepted, settings_patch, settings_merge, text_functions, datestamp, component_tree)
QUERIES = {f.__name__: f for f in _FNS}
E_ = "e as (select event_id, user_id::varchar as key, event_type as topic, value from events)"
T_ = "t as (select event_id, user_id::varchar as key, event_type as topic, floor(epoch_us(ts) / 1000000)::double as sec from events)"
S_ = "s as (select 'SYSTEM/U' || user_id as address, event_id as seq, case event_type when 'error' then 'exit' when 'login' then 'initial' else 'update' end as kind, round(value, 3) as value from events)"
SQL = {
    "filter_key": f"with {E_} select * from e where key = '7'",
    "set_key": f"with {E_} select event_id, 'new key' as key, topic, value from e",
    "fan_in": f"with {E_} select * from e where key = '7' union all select * from e where key = '7' union all select * from e where key = '8'",
    "modulus": "select event_id, ((event_id - 500) % 3 + 3) % 3 as m from events",
    "chunk_events": "select event_id // 19 as chunk, count(*) as n, round(sum(value), 6) as total, min(event_id) as first_id from events group by 1",
    "chunk_by_user": f"with {E_}, r as (select *, row_number() over (partition by key order by event_id) - 1 as nth from e) select key, nth // 4 as chunk, count(*) as n, max(nth % 4)::integer as last_place, min(event_id) as first_id from r group by 1, 2",
    "gate_control": f"with {E_}, c as (select *, last_value(case topic when 'purchase' then true when 'error' then false end ignore nulls) over (partition by key order by event_id rows between unbounded preceding and 1 preceding) as open from e) select key, event_id from c where open and topic not in ('purchase', 'error')",
    "gate_after_n": f"with {E_} select key, event_id from e qualify row_number() over (partition by key order by event_id) <= 3",
    # a purchase opens a closed gate and leaves the count of an open one: at most two messages follow an opening
    "gate_reverting": f"""with recursive {E_}, r as (select *, row_number() over (partition by key order by event_id) as n from e where topic <> 'error'),
        f as (select key, n, event_id, topic, (topic = 'purchase') as open, 0 as handled, false as passes from r where n = 1
            union all
            select r.key, r.n, r.event_id, r.topic,
                case when r.topic = 'purchase' then true when f.open and f.handled + 1 >= 2 then false else f.open end,
                case when r.topic = 'purchase' then (case when f.open then f.handled else 0 end) when f.open and f.handled + 1 >= 2 then 0 else f.handled + 1 end,
                r.topic <> 'purchase' and f.open
            from f join r on r.key = f.key and r.n = f.n + 1)
        select key, event_id from f where passes""",
    "leaky_last_n": f"with {E_} select key, event_id from e qualify row_number() over (partition by key order by event_id desc) <= 3",
    "retention": f"with {E_} select event_id, key from e order by event_id desc limit 1000",
    "cursor_after": f"with {E_} select event_id as seq, key from e where event_id > greatest(100, (select max(event_id) from e) - 500)",
    "sample_hold": "select event_id, round(coalesce(last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row), 0.0), 6) as held from events",
    "trace_sample": f"with {E_} select event_id, key from e qualify row_number() over (partition by key order by event_id) % 3 = 0",
    "listener_latest": f"with {E_} select key, arg_max(value, event_id) as value from e group by key",
    "terminate_total": "select event_id from events order by event_id limit 25",
    "publish_delta": f"with {T_}, k as (select * from t qualify row_number() over (partition by key order by event_id) % 3 = 0) select event_id, coalesce(sec - lag(sec) over (partition by key order by event_id), 0.0) as delta from k",
    "receive_gaps": f"with {T_} select event_id, sec - lag(sec) over (partition by topic order by sec, event_id) as gap from t",
    "counter_gaps": f"with {E_}, c as (select event_id, event_id // 2 as counter, lag(event_id // 2, 1, -1) over (partition by key order by event_id) + 1 as expected from e) select event_id, expected, greatest(counter - expected, 0) as missing from c where counter <> expected",
    "pub_snapshot": f"""with {T_}, c as (select key, floor(sec / 86400) * 86400.0::double as "at", count(*) as n from t group by 1, 2), r as (select key, "at", (sum(n) over (partition by key order by "at"))::bigint as total from c),
        w as (select *, total - coalesce(lag(total) over (partition by key order by "at"), total) as "window", "at" - lag("at") over (partition by key order by "at") as span from r)
        select key, "at", total, "window", round(coalesce("window"::double / span, 0.0), 9) as rate from w""",
    "sub_snapshot": "select user_id, count(*) as received_total, arg_max(event_type, event_id) as last_channel from events group by user_id",
    "trace_merge": f"with {T_} select sec as timestamp, case topic when 'click' then 0 else 1 end::integer as queue from t where topic in ('click', 'view') order by sec, case when event_id % 3 = 0 then -1 else event_id end, 2 limit 100",
    "trace_scope": f"with {E_} select event_id, topic, key as endpoint_id, 'lease' as metric from e where topic in ('click', 'view') and key in ('1', '2', '3', '4')",
    "trace_windows": f"""with {T_}, c as (select distinct key, sec as since from t where topic = 'purchase')
        select t.event_id, t.key as endpoint_id, t.sec as timestamp from t where topic <> 'purchase' and t.sec < (select max(since) from c where c.key = t.key and c.since <= t.sec) + 3600.0""",
    "drop_summary": f"with {E_} select topic, count(*) as received, max(event_id) - min(event_id) + 1 - count(*) as dropped, round(avg(value), 6) as latency_mean from e group by topic",
    "telemetry_view": f"with {T_}, g as (select topic, key, count(*) as total, max(sec) - min(sec) as span from t group by all) select topic, key, total, round(coalesce(case when span <> 0 then total / span end, 0.0), 9) as rate from g order by rate desc, total desc, topic, key limit 20",
    "log_encode": "select event_id, (props::json->>'k')::bigint as k from events",
    "log_scan": "select event_id, (props::json->>'k')::bigint as k from events where event_id % 10 not in (0, 1)",
    "perf_runs": "select event_id // 100 as run_idx, count(*) as n, sum((props::json->>'k')::bigint)::bigint as k from events where event_id % 100 <> 0 group by 1",
    "ndarray_codec": "select vec_id, true as same, case vec_id % 4 when 0 then '<f8' when 1 then '<f4' when 2 then '<i2' else '>i4' end as dtype, '4x16' as shape from embeddings",
    "array_codec": "select vec_id, true as same, len(embedding)::integer as n from embeddings",
    "settings_latest": f"with {S_} select address, arg_max(value, seq) as value, max(seq) as seq from s group by address",
    "settings_effective": f"""with {S_}, l as (select address, arg_max(kind, seq) as kind, arg_max(value, seq) as value from s group by 1), i as (select address, arg_max(value, seq) as initial from s where kind = 'initial' group by 1)
        select address, case when kind = 'exit' then initial else value end as value from l left join i using (address)""",
    "settings_accepted": f"with {S_}, b as (select *, last_value(case when kind <> 'update' then kind end ignore nulls) over (partition by address order by seq rows between unbounded preceding and 1 preceding) as before from s) select address, seq from b where kind = 'update' and before = 'initial'",
    "settings_patch": """select s_suppkey, '{"filter":{"gain":1.5,"ch":' || s_nationkey || '},"name":"' || s_name || '"}' as settings from supplier""",
    "settings_merge": "select n_nationkey, n_nationkey as a, 9::integer as b, 7::integer as c from nation",
    "text_functions": """with p as (select *, p_partkey * 977 as x, 'SYS/' || p_brand || '/' || p_name as adr from part)
        select p_partkey, adr as address, regexp_extract(adr, '^(.*)/[^/]*$', 1) as parent, '&lt;b a=&#x27;' || p_type || '&#x27;&gt;&amp;&quot;' as html,
        concat_ws(':', case when x // 86400 > 0 then (x // 86400) || 'd' end, case when x // 3600 % 24 > 0 then (x // 3600 % 24) || 'h' end, case when x // 60 % 60 > 0 then (x // 60 % 60) || 'm' end, case when x % 60 > 0 then (x % 60) || 's' end) as duration,
        case when length(p_name) <= 8 then p_name else p_name[1:5] || '...' end as cut, 'dbg - ' || case when length(p_name) > 5 then p_name[1:5] || ' [truncated]' else p_name end as debug,
        'out/' || regexp_replace(p_brand, '\\.[^./]*$', '') || '_vs_base.html' as report, 'x=y' as a, 'Cls' as qualname,
        case when p_partkey % 3 = 0 then 'slider' when p_partkey % 2 = 0 then 'int' else 'float' end as widget from p""",
    "datestamp": "select event_id, strftime(ts, '%Y%m%d_%H%M%S') as stamp from events",
    "component_tree": """select 'R' || r_regionkey as address, '' as parent, 0::integer as depth, (select count(*) from nation where n_regionkey = r_regionkey) as below from region
        union all select 'R' || n_regionkey || '/N' || n_nationkey, 'R' || n_regionkey, 1, 0 from nation""",
}
