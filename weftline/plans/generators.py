"""Generators as units: what is sent a message and yields the next result."""

from __future__ import annotations

import logging
import typing
from collections.abc import Callable, Generator, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.plans.pipeline import Unit

log = logging.getLogger(__name__)


def primed(make: Callable[..., Generator]) -> Callable[..., Generator]:
    """Generators that are already at their first yield, ready for send."""

    def start(*args: Any, **kw: Any) -> Generator:
        g = make(*args, **kw)
        next(g)
        return g

    return start


@primed
def chained(*parts: Generator) -> Generator:
    """One generator of several: each result is sent on; None ends a message's way, and so does an error, which is logged."""
    message = None
    while True:
        message = yield message
        for p in parts:
            try:
                message = p.send(message)
            except StopIteration:
                return
            except Exception:
                log.exception("a generator failed")
                message = None
            if message is None:
                break


def through(df: DataFrame, make: Callable[[], Generator], keys: list[str], order_by: str, schema: str) -> DataFrame:
    """Each key's rows, in order and as dicts, through a generator of their own; dicts that it yields are the rows.

    Rows of a key pass one by one: nothing but the generator's state is kept.
    """
    names = [f.split()[0].strip("`") for f in schema.split(",")]
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, order_by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, g = None, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                now = tuple(row[k] for k in keys)
                if g is None or now != key:
                    key, g = now, make()
                    next(g)
                made = g.send(row)
                if made is not None:
                    out.append(made)
            if out:
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in out])

    return ordered.mapInArrow(run, schema)


def kind(make: Callable) -> str:
    """source, sink, map or task, by the hints of the generator's yield and send types."""
    hint = typing.get_type_hints(make).get("return")
    given = typing.get_args(hint)
    if not given:
        raise TypeError("the generator needs a return hint: Generator[yield, send, return]")
    none = type(None)
    gives, takes = given[0] not in (none, None), len(given) > 1 and given[1] not in (none, None)
    return "map" if gives and takes else "source" if gives else "sink" if takes else "task"


def unit_of(make: Callable[..., Generator], keys: list[str], order_by: str, schema: str, **settings: Any) -> Unit:
    """A unit of a generator function; its settings are the function's arguments."""
    made = Unit(settings)
    what = kind(make)
    made.inputs = ("INPUT",) if what in ("map", "sink") else ()
    made.outputs = ("OUTPUT",) if what in ("map", "source") else ()
    if what == "map":
        made.transform = lambda INPUT: through(INPUT, lambda: make(**settings), keys, order_by, schema)  # type: ignore[method-assign]
    elif what == "source":
        from pyspark.sql import SparkSession

        made.transform = lambda: SparkSession.getActiveSession().createDataFrame(list(make(**settings)), schema)  # type: ignore[method-assign]
    else:
        raise TypeError(f"a generator of kind {what} has nothing to give: run it in foreachBatch")
    return made
