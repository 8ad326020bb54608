"""Queries on the test tables, one for each operator, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> tuple[dict[str, Query], dict[str, str]]:
    from weftline.catalog import arrays, messages, reports, streams, topology

    found: tuple[dict[str, Query], dict[str, str]] = {}, {}
    for m in (reports, messages, arrays, topology, streams):
        found[0].update(m.QUERIES)
        found[1].update(m.SQL)
    return found
