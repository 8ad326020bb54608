"""Generators, environments, data sources and traces."""

import io
import json
from collections.abc import Generator

import pytest
from pyspark.sql import functions as F

from weftline.operators import stats
from weftline.plans import environment, generators
from weftline.sources import chunker
from weftline.streaming import listener
from weftline.streaming.stream import drain, rate_source, stop_after_total


def made():
    """A generator that executors get by value."""

    def running(start: float) -> Generator[dict, dict, None]:
        total, out = start, None
        while True:
            row = yield out
            total += row["v"]
            out = {"k": row["k"], "total": total} if row["v"] else None

    return running


def test_generator_unit(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 0.0), ("a", 3, 2.0), ("b", 1, 5.0)], "k string, i long, v double")
    unit = generators.unit_of(made(), ["k"], "i", "k string, total double", start=10.0)
    assert sorted(map(tuple, unit.transform(INPUT=df).collect())) == [("a", 11.0), ("a", 13.0), ("b", 15.0)]
    assert generators.kind(made()) == "map"
    with pytest.raises(TypeError):
        generators.kind(lambda: None)


def test_chained_generators():
    @generators.primed
    def add(n):
        x = None
        while True:
            x = yield None if x is None else x + n

    @generators.primed
    def fails():
        x = None
        while True:
            x = yield x
            if x == 3:
                raise ValueError(x)

    g = generators.chained(add(1), add(10))
    assert [g.send(i) for i in range(3)] == [11, 12, 13]
    g = generators.chained(add(1), fails())
    assert [g.send(i) for i in range(3)] == [1, 2, None]


def test_environment(spark, tmp_path):
    path = tmp_path / "lock"
    path.write_text("1")
    a = environment.environment(spark, [str(path)])
    path.write_text("2")
    b = environment.environment(spark, [str(path)])
    diff = stats.environment_diff(a, b)
    assert len(environment.warnings(diff)) == 1 and "->" in environment.diff_text(diff)


def test_chunk_source(spark):
    chunker.register(spark)
    data = [float(i) for i in range(45)]
    options = {"data": json.dumps(data), "chunk_len": "19", "fs": "1000"}
    got = spark.read.format("array_chunks").options(**options).load().orderBy("chunk").collect()
    assert [len(r["data"]) for r in got] == [19, 19, 7] and got[1]["offset"] == 0.019
    stream = spark.readStream.format("array_chunks").options(**options, step="2").load()
    seen = []
    stop_after_total(stream, 3, lambda df, n: seen.extend(df.orderBy("chunk").collect()))
    assert sum((r["data"] for r in seen), []) == data


def test_trace(spark):
    sink = io.StringIO()
    trace = listener.Trace(sink)
    spark.streams.addListener(trace)
    try:
        assert stop_after_total(rate_source(spark, 20).where(F.col("value") >= 0), 5, lambda df, n: None) >= 5
    finally:
        spark.streams.removeListener(trace)
    assert sink.getvalue().startswith("Time,Source")
    assert listener.snapshot([], spark).count() == 0
    assert callable(drain)


def test_pause_and_settings(spark, tmp_path):
    from weftline.streaming.stream import Controlled, configured

    folder = str(tmp_path / "in")
    spark.range(5).write.parquet(folder)
    stream = spark.readStream.schema("id long").parquet(folder)
    seen = []
    q = Controlled(stream, lambda df, n: seen.extend(r["id"] for r in df.collect()))
    q.resume()
    q.sync()
    spark.range(5, 8).write.mode("append").parquet(folder)
    q.resume()
    q.sync()
    assert sorted(seen) == list(range(8))
    scale, got = [10], []
    run = configured(stream, lambda: scale[0], lambda df, k: df.select((F.col("id") * k).alias("x")), lambda df, n: got.extend(r["x"] for r in df.collect()))
    run.processAllAvailable()
    run.stop()
    assert sorted(got) == [10 * i for i in range(8)]
