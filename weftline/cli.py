"""Command line: run a query, compare two benchmark folders' reports, draw a graph."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from weftline.catalog import all_queries, reports
from weftline.operators import stats, topology
from weftline.plans import report
from weftline.session import session


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftline")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("query", help="show a query's rows")
    run.add_argument("name")
    run.add_argument("tables")
    compare = commands.add_parser("compare", help="report of candidate against baseline")
    compare.add_argument("tables")
    compare.add_argument("--html")
    compare.add_argument("--band", type=float, default=10.0)
    draw = commands.add_parser("graph", help="draw edges of a CSV file with src,dst")
    draw.add_argument("edges")
    draw.add_argument("--kind", choices=("mermaid", "graphviz"), default="mermaid")
    draw.add_argument("--direction", default="LR")
    draw.add_argument("--compact", type=int, default=0)
    draw.add_argument("--contract", action="store_true")
    draw.add_argument("--url", choices=tuple(report.VIEWERS))
    given = parser.parse_args(args)
    spark = session()
    if given.command == "query":
        all_queries()[0][given.name](spark, given.tables).show(50, truncate=False)
    elif given.command == "compare":
        runs = stats.run_then_median(reports.entries(spark, given.tables), "run", ["side", *reports.KEYS], reports.METRICS)
        rel = stats.relative(runs.where("side = 1"), runs.where("side = 0"), reports.KEYS, reports.METRICS)
        deltas = stats.metric_deltas(rel, reports.KEYS, reports.METRICS, given.band)
        counts = {r["class"]: r["n"] for r in deltas.groupBy("class").agg(F.count("*").alias("n")).collect()}
        best, worst = ([r.asDict() for r in stats.top_deltas(deltas, c, reports.KEYS).collect()] for c in ("improvement", "regression"))
        print(report.text_table(rel, [*reports.KEYS, *reports.METRICS], group=["config", "comms"]))
        print(report.delta_summary(counts, best, worst))
        if given.html:
            with open(given.html, "w") as f:
                f.write(report.html_report("Relative to baseline", deltas, [*reports.KEYS, "metric", "value", "score", "class"], "score"))
    else:
        print(drawn(spark.read.csv(given.edges, header=True), given.kind, given.direction, given.compact, given.contract, given.url))
    return 0


def drawn(edges, kind: str = "mermaid", direction: str = "LR", compact: int = 0, contract: bool = False, url: str | None = None) -> str:
    """The text of a graph, contracted and compacted first if asked; or its address."""
    if contract:
        edges = topology.contract_proxies(edges)
    edges = topology.compact(edges, compact)
    text = report.graph_text([(r["src"], r["dst"]) for r in report.all_rows(edges.select("src", "dst").distinct(), report.MOST_ROWS)], kind, direction)
    return report.drawing_url(text, url) if url else text


if __name__ == "__main__":
    sys.exit(main())
