"""Labelled arrays, logs, replays and graph sessions: what the queries do not show."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import codec
from weftline.operators.labelled import Coordinates, Labelled, Linear, concatenate
from weftline.plans import control, report
from weftline.sources import logs, replay


@pytest.fixture(scope="module")
def array(spark):
    frame = spark.range(6).select(F.floor(F.col("id") / 2).cast("int").alias("time"), (F.col("id") % 2).cast("int").alias("ch"), F.col("id").cast("double").alias("value"))
    return Labelled(frame, ("time", "ch"), (3, 2), {"time": Linear(0.5, 10.0), "ch": Coordinates(("a", "b"))}, "k")


def cells(x):
    return sorted((*[r[d] for d in x.dims], r["value"]) for r in x.frame.collect())


def test_lookup(array):
    assert array.place("ch") == 1 and array.place(-1) == 1 and array.name(0) == "time" and array.length("time") == 3
    assert array.values("time") == [10.0, 10.5, 11.0] and array.values("ch") == ["a", "b"]
    bare = Labelled(array.frame, array.dims, array.shape)
    assert bare.axis("time") == Linear() and bare.values("time") == [0.0, 1.0, 2.0]
    for wrong in ("nowhere", ""):
        with pytest.raises(ValueError, match="not present"):
            array.axis(wrong)
    with pytest.raises(IndexError):
        array.place(2)
    with pytest.raises(ValueError, match="unique"):
        Labelled(array.frame, ("time", "time"), (3, 2))
    with pytest.raises(ValueError, match="labels"):
        Labelled(array.frame, array.dims, array.shape, {"ch": Coordinates(("a",))})


def test_selection_keeps_axes(array):
    x = array.isel(time=slice(1, 3), ch=[1])
    assert x.shape == (2, 1) and x.values("time") == [10.5, 11.0] and x.values("ch") == ["b"]
    assert cells(x) == [(0, 0, 3.0), (1, 0, 5.0)]
    assert array.sel(time=slice(10.5, None)).values("time") == [10.5, 11.0]
    t = array.transpose()
    assert t.dims == ("ch", "time") and t.shape == (2, 3) and t.frame.columns == ["ch", "time", "value"]
    with pytest.raises(ValueError, match="linear"):
        array.sel(ch=slice(0, 1))


def test_concatenation(array, spark):
    both = concatenate(array, array, dim="time")
    assert both.shape == (6, 2) and both.axes["time"] == Linear(0.5, 10.0) and both.key == "k"
    assert cells(both) == sorted([(t + 3 * i, c, 2.0 * t + c) for t in range(3) for c in range(2) for i in range(2)])
    named = concatenate(array, array, dim="ch")
    assert named.values("ch") == ["a", "b", "a", "b"]
    assert concatenate(array, array, dim="ch", axis=Linear(2.0)).values("ch") == [0.0, 2.0, 4.0, 6.0]
    other = Labelled(array.frame, array.dims, array.shape, array.axes, "j")
    stacked = concatenate(array, other, dim="trial")
    assert stacked.dims == ("trial", "time", "ch") and stacked.shape == (2, 3, 2) and stacked.key == ""
    assert concatenate(array, other, dim="time", filter_key="j").shape == (3, 2)
    with pytest.raises(ValueError, match="incompatible"):
        concatenate(array, array.transpose(), dim="time")
    with pytest.raises(ValueError, match="lengths"):
        concatenate(array, array.isel(ch=0), dim="time")
    with pytest.raises(ValueError, match="nothing"):
        concatenate(array, dim="time", filter_key="none")


def test_concatenation_computes_nothing(array, spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "")
    keyed = Labelled(array.frame.withColumn("key", F.lit("k")), array.dims, array.shape, array.axes, "k")
    z = concatenate(keyed, keyed, dim="time")
    assert not tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setJobGroup("", "")
    assert {r["key"] for r in z.frame.collect()} == {"k"}


def test_array_codec_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [-1.0])]
    df = spark.createDataFrame(rows, "id int, data array<double>").repartition(1)
    for kind in ("<f8", "<i2", ">f4"):
        got = df.select("id", codec.decoded_array(codec.encoded_array(F.col("data"), kind), kind).alias("x")).collect()
        assert sorted(map(tuple, got)) == rows
    bad = spark.createDataFrame([("ndarray", "AAAA", "<f8", [1]), ("ndarray", "AAA=", "no type", [1]), ("ndarray", "AAA=", "O", [1]), ("x", "AAA=", "<i2", [1]), ("ndarray", "AAA=", "<i2", [2]), ("ndarray", "AAA=", "<i2", [1])], codec.ARRAY_FIELDS)
    got = bad.select(codec.decoded_ndarray(F.struct("__type__", "data", "dtype", "shape")).alias("x")).collect()
    assert [r["x"] and r["x"]["data"] for r in got] == [None] * 5 + [[0.0]]


def test_logger(spark, tmp_path):
    now = [0.0]
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    logger = logs.MessageLogger(one)
    batch = lambda i: spark.createDataFrame([(float(i), f"m{i}")], "ts double, obj string")
    read = lambda p: sorted(r["obj"] for r in logs.message_log(spark, p).collect())
    assert logger.log(batch(0)).collect()[0]["obj"] == "m0"
    assert logger.open(spark, one) is None and logger.open(spark, two) == two
    logger.log(batch(1))
    assert logger.close(one) == one and logger.close(one) is None
    logger.log(batch(2))
    assert read(one) == ["m0", "m1"] and read(two) == ["m1", "m2"]
    assert sum(codec.START in r["value"] for r in spark.read.text(one).collect()) == 1
    logger.close(two)
    logger.open(spark, two)  # truncated
    assert read(two) == []
    slow = logs.MessageLogger(one, 10.0, lambda: now[0])
    slow.log(batch(3))
    now[0] = 5.0
    slow.log(batch(4))
    assert read(one) == []
    now[0] = 11.0
    slow.log(batch(5))
    assert read(one) == ["m3", "m4", "m5"]
    slow.log(batch(6))
    slow.close(one)
    assert read(one) == ["m3", "m4", "m5", "m6"]


def steps(stream, now, times):
    at, out = stream.initialOffset(), []
    for t in times:
        now[0] = t
        rows, after = stream.read(json.loads(json.dumps(at)))
        rows = list(rows)
        assert list(stream.readBetweenOffsets(at, json.loads(json.dumps(after)))) == rows
        out.append([json.loads(r[3]) if r[3] else ("end", r[5]) if r[4] else None for r in rows])
        at = after
    return out


@pytest.fixture
def log(tmp_path):
    def write(name, times):
        path = tmp_path / name
        lines = [{"ts": 0, "obj": codec.START}, *({"ts": t, "obj": f"{name}{i}"} for i, t in enumerate(times))]
        path.write_text("\n".join(json.dumps(x) for x in lines) + "\nbroken {\n")
        return str(path)

    return write


def test_replay_pace(log):
    """Pauses over a minute hold, none is cut; marker and broken lines count as lines only."""
    now = [0.0]
    a = log("a", [0.0, 100.0, 300.0])
    stream = replay.ReplayStream(a, 0.0, 100, clock=lambda: now[0])
    assert steps(stream, now, [1000.0, 1099.0, 1100.0, 1299.9, 1300.0]) == [[None, "a0"], [], ["a1"], [], ["a2", None, ("end", 3)]]
    stream = replay.ReplayStream(a, 0.01, 100, clock=lambda: now[0])
    assert steps(stream, now, [0.0, 99.0, 100.0, 250.0, 300.0]) == [[None], [], ["a0"], ["a1"], ["a2", None, ("end", 3)]]
    stream = replay.ReplayStream(f"{a},{log('b', [5.0])}", None, 3, clock=lambda: now[0])
    assert steps(stream, now, [0.0] * 4) == [[None, "a0", "a1"], ["a2", None, ("end", 3)], [None, "b0", None], [("end", 1)]]


def test_replay_commands(log, tmp_path):
    now = [0.0]
    control_file = tmp_path / "control"
    a, b, c = log("a", range(5)), log("b", range(5)), log("c", [0.0])
    stream = replay.ReplayStream(f"{a},{b}", None, 2, str(control_file), lambda: now[0])
    at, seen = stream.initialOffset(), []

    def step(command=""):
        nonlocal at
        if command:
            with control_file.open("a") as f:
                f.write(command + "\n")
        before = at
        rows, at = stream.read(json.loads(json.dumps(at)))
        rows = list(rows)
        assert list(stream.readBetweenOffsets(before, json.loads(json.dumps(at)))) == rows
        return [json.loads(r[3]) if r[3] else ("end", r[5]) if r[4] else None for r in rows]

    assert step() == [None, "a0"]
    assert step("pause") == [] and step() == []
    assert step("resume") == ["a1", "a2"]
    assert step("skip") == [("end", 3), None]
    assert step() == ["b0", "b1"]
    assert step("stop") == [("end", 2)] and step() == []
    assert step(f"add {c}") == [None, "c0"]
    assert step() == [None, ("end", 1)] and step() == []


def test_graph_session(spark):
    s = control.GraphSession(spark, "me")
    one = s.connect("a", "b")
    s.connect("b", "c")
    with pytest.raises(ValueError, match="cycle"):
        s.connect("c", "a")
    edges = lambda df: sorted((r["src"], r["dst"]) for r in df.collect())
    assert edges(s.snapshot()) == [("a", "b"), ("b", "c")] and edges(s.snapshot(one)) == [("a", "b")]
    s.disconnect("a", "b")
    assert edges(s.snapshot()) == [("b", "c")]
    assert edges(s.revert(one)) == [("a", "b")]
    found = [(r["change"], r["src"], r["dst"]) for r in control.topology_changes(s.events, 1).orderBy("seq").collect()]
    assert found[:2] == [("added", "b", "c"), ("removed", "a", "b")] and sorted(found[2:]) == [("added", "a", "b"), ("removed", "b", "c")]
    s.close()
    assert edges(s.snapshot()) == []


def test_bench_grid():
    grid = report.bench_grid({"size": [1, 2], "kind": ["x", "y"]}, 3, seed=4)
    assert len(grid) == 12 and grid == report.bench_grid({"size": [1, 2], "kind": ["x", "y"]}, 3, seed=4) != report.bench_grid({"size": [1, 2], "kind": ["x", "y"]}, 3)
    assert report.bench_grid({"size": [1, 2], "kind": ["x", "y"]}, zipped=True) == [{"size": 1, "kind": "x", "iteration": 0}, {"size": 2, "kind": "y", "iteration": 0}]
    with pytest.raises(ValueError):
        report.bench_grid({"size": [1], "kind": ["x", "y"]}, zipped=True)
