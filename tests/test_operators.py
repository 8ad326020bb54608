"""Operators on small inputs, at their edges."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.catalog import streams
from weftline.functions import axis, codec, text
from weftline.operators import arrays, messages, stats, telemetry, topology
from weftline.plans import pipeline, report
from weftline.sources import logs, replay
from weftline.streaming import stream


def vector(spark, values, shape_dims=None):
    return spark.createDataFrame([(0, [float(v) for v in values])], "id long, data array<double>")


@pytest.mark.parametrize("shape", [(4, 5, 6), (1, 3), (7,)])
def test_arrays_against_numpy(spark, shape):
    dims = ["abc"[i] for i in range(len(shape))]
    x = np.arange(math.prod(shape), dtype=float).reshape(shape)
    long = arrays.to_long(vector(spark, x.ravel()), ["id"], "data", shape, dims)
    for axis_ in range(len(shape)):
        two = arrays.as_2d(long, dims, shape, dims[axis_]).collect()
        want = np.moveaxis(x, axis_, 0).reshape(shape[axis_], -1)
        assert all(want[r["row"], r["col"]] == r["value"] for r in two) and len(two) == x.size
        got = {tuple(r[d] for d in dims): r["value"] for r in arrays.isel(long, dims[axis_], slice(None, None, 2), shape[axis_]).collect()}
        taken = np.take(x, range(0, shape[axis_], 2), axis_)
        assert got == {i: taken[i] for i in np.ndindex(taken.shape)}
    order = tuple(reversed(range(len(shape))))
    back = vector(spark, x.ravel()).select(arrays.transpose_packed(F.col("data"), shape, order)).first()[0]
    assert back == list(x.transpose(order).ravel())


@pytest.mark.parametrize("n,width,step", [(10, 3, 1), (10, 4, 3), (5, 5, 2), (4, 5, 1), (6, 0, 1)])
def test_sliding_windows(spark, n, width, step):
    got = vector(spark, range(n)).select(arrays.sliding_windows("data", width, step)).first()[0]
    want = [] if width == 0 or n < width else np.lib.stride_tricks.sliding_window_view(np.arange(n, dtype=float), width)[::step].tolist()
    assert got == want


def test_too_wide_window_fails(spark):
    with pytest.raises(Exception, match="longer"):
        vector(spark, range(3)).select(arrays.sliding_windows("data", 5)).collect()


def test_chunks_restore(spark):
    got = vector(spark, range(45)).select(arrays.chunks("data", 19, 1000.0, 1.0)).first()[0]
    assert [len(c["data"]) for c in got] == [19, 19, 7]
    assert [round(c["offset"], 6) for c in got] == [1.0, 1.019, 1.038]
    assert sum((c["data"] for c in got), []) == [float(i) for i in range(45)]
    assert vector(spark, []).select(arrays.chunks("data", 19)).first()[0] == []


def test_wrong_shape_and_dims_fail(spark):
    with pytest.raises(Exception, match="fit"):
        arrays.to_long(vector(spark, range(5)), ["id"], "data", (2, 3), ["a", "b"]).collect()
    with pytest.raises(ValueError):
        arrays.to_long(vector(spark, range(4)), ["id"], "data", (2, 2), ["a", "a"])
    long = arrays.to_long(vector(spark, range(4)), ["id"], "data", (2, 2), ["a", "b"])
    with pytest.raises(Exception, match="longer"):
        arrays.rename_dims(long, {"a": None}).collect()
    with pytest.raises(ValueError):
        arrays.slice_along(long, "z", 0, 2)
    with pytest.raises(IndexError):
        arrays.isel(long, "a", slice(2, 2), 2)


def test_labels(spark):
    long = arrays.to_long(vector(spark, range(400)), ["id"], "data", (400,), ["x"])
    got = sorted(r["value"] for r in arrays.sel(long, "x", -10.75, 1.5, 400, 0.25, -50.0).collect())
    assert got == [float(i) for i in range(157, 206)]
    assert arrays.isel(long, "x", -1, 400).collect()[0]["value"] == 399.0
    assert arrays.isel_offset(-50.0, 0.25, slice(157, 206), 400) == -10.75
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "v double").select(axis.axis_index("v")).collect()
    assert [r[0] for r in halves] == [0, 2, 2]


def test_concatenation_keys(spark):
    x = arrays.to_long(vector(spark, range(4)), ["id"], "data", (2, 2), ["a", "b"]).withColumn("key", F.lit("k"))
    assert {r["key"] for r in arrays.concatenate([x, x], "a", [2, 2]).collect()} == {"k"}
    both = arrays.concatenate([x, x.withColumn("key", F.lit("j"))], "n", [1, 1], new=True).collect()
    assert {r["key"] for r in both} == {""} and {r["n"] for r in both} == {0, 1}


def fold(events, **settings):
    state, out = messages.GateState(**settings), []
    for seq, open_ in events:
        if open_ is None:
            if state.handle():
                out.append(seq)
        else:
            state.turn(open_)
    return out


@pytest.mark.parametrize("start,default,after", [(True, False, 3), (False, True, 2), (False, False, 2), (True, True, None), (False, False, None)])
def test_gate(spark, start, default, after):
    r = random.Random(1)
    events = [(i, r.choice([None, None, None, True, False])) for i in range(200)]
    df = spark.createDataFrame([("k", i, o) for i, o in events], "key string, seq long, open boolean")
    msgs, ctl = df.where("open is null").select("key", "seq"), df.where("open is not null")
    got = messages.gate_reverting(msgs, ctl, "seq", ["key"], start, default, after)
    assert sorted(x["seq"] for x in got.collect()) == fold(events, start_open=start, default_open=default, default_after=after)
    if after is None:
        assert sorted(x["seq"] for x in messages.gate(msgs, ctl, "seq", ["key"], start).collect()) == fold(events, start_open=start, default_open=default, default_after=None)


def test_newest_of_hundred(spark):
    got = messages.newest(spark.range(100).withColumnRenamed("id", "seq"), 3, "seq")
    assert sorted(r["seq"] for r in got.collect()) == [97, 98, 99]


def test_ab_summary(spark):
    pairs = spark.createDataFrame([("c", 10.0, 12.0), ("c", 8.0, 9.0)], "case_id string, a double, b double")
    r = stats.ab_summary(pairs, "case_id", "a", "b").first()
    assert (r["a_median"], r["b_median"], r["pair_count"], r["b_faster_pairs"]) == (9.0, 10.5, 2, 0)
    with pytest.raises(Exception, match="same cases"):
        stats.ab_pairs(pairs.select("case_id", "a"), pairs.limit(0).select("case_id", F.col("a")), ["case_id"], "a").collect()


def test_statistics_at_the_edges(spark):
    one = spark.createDataFrame([("x", 4.0, 1), ("y", 1.0, 1), ("y", 2.0, 2), ("y", 3.0, 3), ("y", 4.0, 4)], "k string, v double, i long")
    cv = {r["k"]: r["cv"] for r in one.groupBy("k").agg(stats.coef_var("v").alias("cv")).collect()}
    assert cv["x"] == 0.0 and round(cv["y"], 6) == round(np.std([1, 2, 3, 4]) / 2.5, 6)
    assert {r["k"]: r["m"] for r in stats.ranked_median(one, ["k"], "v", "m").collect()} == {"x": 4.0, "y": 3.0}
    same = spark.createDataFrame([("a", 1.0, 2.0, 0), ("a", 1.0, 2.5, 5)], "k string, s double, r double, c long")
    m = stats.load_metrics(same, ["k"], "s", "r", "c", 8).first()
    assert m["sample_rate_mean"] is None and m["dropped"] == 4


def test_first_snapshot_is_zero(spark):
    t = spark.createDataFrame([("p", 0.0, 2), ("p", 1.0, 3)], "k string, at double, total long")
    got = telemetry.snapshots(t, "total", "at", ["k"]).orderBy("at").collect()
    assert [(r["window"], r["rate"]) for r in got] == [(0, 0.0), (1, 1.0)]


def test_scope(spark):
    s = spark.createDataFrame([("t", "e", "m")], "topic string, endpoint_id string, metric string")
    assert telemetry.trace_scope(s, [], [], None).count() == 1
    assert telemetry.trace_scope(s, [], [], []).count() == 0


EDGES = [("a", "b"), ("b", "c"), ("c", "d"), ("b", "e"), ("w", "x"), ("x", "y"), ("x", "z"), ("y", "z")]


def graph(spark, edges=EDGES):
    return spark.createDataFrame(edges, "src string, dst string")


def test_reach_and_cycles(spark):
    g = graph(spark)
    far = {}
    for r in topology.downstream(g, topology.nodes(g)).collect():
        far.setdefault(r["start"], set()).add(r["node"])
    assert far["a"] == {"a", "b", "c", "d", "e"} and far["w"] == {"w", "x", "y", "z"} and far["z"] == {"z"}
    unknown = spark.createDataFrame([("nobody",)], "node string")
    assert [r["node"] for r in topology.upstream(g, unknown).collect()] == ["nobody"]
    owned = g.withColumn("owner", F.lit("s"))
    for src, dst in (("d", "a"), ("a", "a")):
        with pytest.raises(ValueError):
            topology.add_edge(owned, src, dst)
    more, new = topology.add_edge(owned, "a", "e", "t")
    assert new and more.count() == 9
    again, new = topology.add_edge(more, "a", "e", "u")
    assert not new and topology.topology(topology.remove_edge(again, "a", "e", "u")).count() == 9


def test_contraction_and_levels(spark):
    g = graph(spark, [("S/A/OUT", "T1"), ("T1", "S/B/IN"), ("T1", "S/C/IN"), ("S/C/OUT", "S/D/E/IN")])
    assert {tuple(r) for r in topology.contract_proxies(g).collect()} == {("S/A/OUT", "S/B/IN"), ("S/A/OUT", "S/C/IN"), ("S/C/OUT", "S/D/E/IN")}
    assert {r["node"]: r["level"] for r in topology.levels(g).collect()}["S"] == 3
    small = topology.compact(topology.contract_proxies(g), 1)
    assert {tuple(r) for r in small.collect()} == {("S/A", "S/B"), ("S/A", "S/C"), ("S/C", "S/D/E")}
    with pytest.raises(ValueError):
        topology.compact(graph(spark, [("A", "A/B")]), 1)


def test_text(spark):
    r = spark.range(1).select(
        text.duration(F.lit(90061)).alias("d"), text.formatted(F.lit("x"), F.lit(float("nan")), True).alias("n"), text.metric_class(F.lit("latency_mean"), F.lit(float("nan"))).alias("c"),
        text.metric_class(F.lit("latency_mean"), F.lit(120.0)).alias("slow"), text.metric_class(F.lit("data_rate"), F.lit(110.0)).alias("edge"), text.ab_verdict(F.lit(0.0)).alias("v"),
        text.parent(F.lit("a/b/c")).alias("p"), text.parent(F.lit("a")).alias("root"), text.assignments(F.lit("A=1 B=x=y A=2")).alias("m"),
    ).first()
    assert (r["d"], r["n"], r["c"], r["slow"], r["edge"], r["v"], r["p"], r["root"]) == ("1d:1h:1m:1s", "nan", "neutral", "regression", "neutral", "improvement", "a/b", "")
    assert r["m"] == {"A": "2", "B": "x=y"}
    with pytest.raises(Exception, match="not KEY=VALUE"):
        spark.range(1).select(text.assignments(F.lit("A"))).collect()


def test_logs_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.5, "x"), (2.5, None)], "ts double, obj string")
    logs.write_log(df, str(tmp_path / "log"))
    assert sorted(logs.message_log(spark, str(tmp_path / "log")).collect()) == [(1.5, "x"), (2.5, None)]


def test_replay(spark, tmp_path):
    lines = [{"ts": 0, "obj": codec.START}, *({"ts": float(i), "obj": {"k": i}} for i in range(5))]
    path = tmp_path / "log.txt"
    path.write_text("\n".join(json.dumps(x) for x in lines) + "\nbroken {\n")
    replay.register(spark)
    got = spark.read.format("message_replay").option("path", str(path)).load().orderBy("line_no").collect()
    assert [json.loads(r["obj"])["k"] for r in got] == list(range(5))


def test_replay_stream(spark, tmp_path):
    from weftline.streaming.stream import stop_after_total

    path = tmp_path / "log.txt"
    path.write_text("\n".join(json.dumps({"ts": float(i), "obj": i}) for i in range(7)))
    replay.register(spark)
    stream = spark.readStream.format("message_replay").option("path", str(path)).option("step", "3").load()
    seen = []
    assert stop_after_total(stream, 7, lambda df, n: seen.extend(r["obj"] for r in replay.messages(df).orderBy("line_no").collect())) >= 7
    assert seen == [str(i) for i in range(7)]


def test_pipeline(spark):
    add = pipeline.unit(lambda INPUT: INPUT.withColumn("id", F.col("id") + 1))
    got = []
    sink = pipeline.unit(lambda INPUT: got.extend(r["id"] for r in INPUT.collect()), outputs=())
    p = pipeline.Pipeline({"A": add, "B": sink}, [("IN", "A/INPUT"), ("A/OUTPUT", "T"), ("T", "B/INPUT"), ("A/OUTPUT", "B/INPUT")])
    p.streams({"IN": spark.range(3)})
    assert sorted(got) == [1, 2, 3]
    with pytest.raises(ValueError, match="cycle"):
        pipeline.Pipeline({}, [("a", "b"), ("b", "a")])
    with pytest.raises(TypeError):
        pipeline.topic_name(3)


def test_drawings():
    edges = [("S/A/OUT", "S/B/IN"), ("S/B/OUT", "T")]
    for kind in ("mermaid", "graphviz"):
        drawn = report.graph_text(edges, kind)
        assert drawn.count("->" if kind == "graphviz" else "-->") == 2 and "OUT" in drawn
    assert report.drawing_url("flowchart LR", "ink").startswith("https://mermaid.ink/img/")
    with pytest.raises(ValueError):
        report.graph_text(edges, "svg")
    with pytest.raises(ValueError):
        report.drawing_url("x", "nowhere")
    order = report.pair_order(5, 1)
    assert sorted(order) == ["AB", "AB", "AB", "BA", "BA"] and order == report.pair_order(5, 1)


def test_no_row_holds_all_targets_of_a_node(spark):
    edges = [("hub", f"t{i}") for i in range(7)] * 2 + [("a", "hub")]
    got = topology.adjacency(graph(spark, edges), most=3)
    listed = {(r["node"], r["part"]): r["targets"] for r in got.collect()}
    assert [listed["hub", k] for k in range(3)] == [["t0", "t1", "t2"], ["t3", "t4", "t5"], ["t6"]]
    assert listed["a", 0] == ["hub"] and listed["t0", 0] == [] and len(listed) == 3 + 1 + 7
    assert {tuple(r) for r in topology.flat_edges(got).collect()} == set(edges)


def test_a_gate_leaves_the_session_as_it_is(spark):
    (name,) = stream.GATE_SETTINGS
    before = spark.conf.get(name)
    with stream.settings(spark, stream.GATE_SETTINGS):
        assert spark.conf.get(name) == stream.GATE_SETTINGS[name]
    assert spark.conf.get(name) == before
    assert streams.stream_gate(spark, "/root/testdata/sf0.001").count() > 0
    assert spark.conf.get(name) == before
