"""Queries whose SQL reads a part of a table, against the whole table."""

import re

import duckdb
import pandas as pd
import pytest
from test_queries import QUERIES, SQL, rows

from weftline.cli import drawn
from weftline.plans import report
from weftline.session import TABLES, table
from weftline.sources import logs


@pytest.mark.parametrize("name", ["topology", "levels", "routing", "stack_axis", "perf_runs", "stream_sessions", "topology_changes"])
def test_whole_tables_at_a_larger_size(spark, name):
    """SQL and query over ten times the tables of the other tests, so that neither stops at some id."""
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    want = c.execute(SQL[name])
    columns = [x[0] for x in want.description]
    got = QUERIES[name](spark, "/root/testdata/sf0.01")
    got = rows(got.columns, got.collect())
    assert got == rows(columns, want.fetchall())
    assert len(got) >= {"topology": 1500, "levels": 1500, "routing": 1500, "stack_axis": 2 * 64 * 500, "perf_runs": 100, "stream_sessions": 150, "topology_changes": 1000}[name]


def test_no_query_stops_at_an_id():
    assert not [n for n, q in SQL.items() if re.search(r"(custkey|vec_id|event_id|user_id) *< *\d", q)]


@pytest.mark.parametrize("files", [("a",), ("a", "b", None)])
def test_runs_over_many_ranges(spark, files):
    lines = [(f, i, '{"env": 1}' if i % 7 == 3 else f'{{"k": {i}}}') for f in files for i in range(200)]
    df = spark.createDataFrame(lines, "file string, line_no long, value string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = logs.perf_runs(df if len(files) > 1 else df.drop("file"), "k long")
        got = [((r["file"] if len(files) > 1 else "a"), r["run_idx"], r["k"]) for r in runs.collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [(f, max(0, sum(j % 7 == 3 for j in range(i + 1)) - 1), i) for f in files for i in range(200) if i % 7 != 3]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def folder(spark, at):
    """Events of sf0.01 as a folder of files, the last days in the first file."""
    events = table(spark, "/root/testdata/sf0.01", "events").toPandas().sort_values("ts", ascending=False)
    (at / "events.parquet").mkdir()
    for i in range(4):
        part = events.iloc[i * len(events) // 4 : (i + 1) * len(events) // 4]
        part.astype({"ts": "datetime64[us]"}).to_parquet(at / "events.parquet" / f"part-{i}.parquet", index=False)
    return events


def test_sessions_of_every_user(spark, tmp_path):
    events = folder(spark, tmp_path)
    want = []
    for user, some in events.groupby("user_id")["ts"]:
        open_ = None
        for t in sorted(x.value // 1000 for x in some):
            if open_ and t < open_[1] + 7200 * 10**6:
                open_ = [open_[0], t, open_[2] + 1]
                want[-1] = (user, *open_)
            else:
                open_ = [t, t, 1]
                want.append((user, *open_))
    want = [(u, a // 10**6, (b + 7200 * 10**6) // 10**6, n) for u, a, b, n in want]
    got = [(r["user_id"], r["start"], r["end"], r["n"]) for r in QUERIES["stream_sessions"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and max(u for u, *_ in got) >= 20


def test_windows_of_files_in_any_order(spark, tmp_path):
    events = folder(spark, tmp_path)
    days = events.groupby(events["ts"].dt.floor("D"))["event_id"].count()
    want = sorted((x.value // 10**9, n) for x, n in days.items() if x + pd.Timedelta(days=1) <= events["ts"].max())
    assert sorted((r["start"], r["n"]) for r in QUERIES["stream_tumbling"](spark, str(tmp_path)).collect()) == want


def test_reports_and_drawings_leave_nothing_out(spark, monkeypatch):
    monkeypatch.setattr(report, "MOST_ROWS", 5)
    edges = spark.range(6).selectExpr("concat('a', id) as src", "concat('b', id) as dst")
    assert drawn(edges.limit(5)).count("-->") == 5
    for render in (lambda: drawn(edges), lambda: report.text_table(edges, ["src"], most=5), lambda: report.html_report("x", edges, ["src"], most=5)):
        with pytest.raises(ValueError, match="more than 5 rows"):
            render()
