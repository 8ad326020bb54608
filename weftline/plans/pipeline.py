"""Pipelines of units: a graph of named streams whose units are DataFrame functions.

Components are named, edges validated, and units composed in topological
order into one logical plan for each output; Spark then plans and runs them.
"""

from __future__ import annotations

import dataclasses
import inspect
from collections import defaultdict
from collections.abc import Callable, Iterable
from enum import Enum
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

Transform = Callable[..., DataFrame | dict[str, DataFrame] | None]


def topic_name(end: Any) -> str:
    """A stream end as text, enum member or (component, stream)."""
    if isinstance(end, str):
        return end
    if isinstance(end, Enum):
        return str(end.value)
    if isinstance(end, tuple) and len(end) == 2:
        return "/".join(map(str, end))
    raise TypeError(f"not a stream: {end!r}")


@dataclasses.dataclass(frozen=True)
class Settings:
    """Base of settings; derived classes are frozen dataclasses."""


def replaced(settings: Any, path: str, value: Any) -> Any:
    """Settings with one field set, by its dotted path; an unknown field raises."""
    head, _, rest = path.partition(".")
    if head not in {f.name for f in dataclasses.fields(settings)}:
        raise AttributeError(f"{type(settings).__name__} has no field {head}")
    return dataclasses.replace(settings, **{head: replaced(getattr(settings, head), rest, value) if rest else value})


def settings_schema(kind: type) -> list[dict[str, Any]]:
    """name, type and default of each field, with its metadata (bounds, choices)."""
    rows = []
    for f in dataclasses.fields(kind):
        default = None if f.default is dataclasses.MISSING else f.default
        rows.append({"name": f.name, "type": f.type if isinstance(f.type, str) else getattr(f.type, "__name__", str(f.type)), "default": default, **f.metadata})
    return rows


class Unit:
    """A component with named inputs and outputs.

    transform gets a DataFrame for each input, by name, and returns one for
    its only output, or a dict by output.  A unit that returns nothing is a
    sink.  It may be an existing function: see unit().
    """

    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()

    def __init__(self, settings: Any = None):
        self.settings = settings

    def transform(self, **inputs: DataFrame) -> DataFrame | dict[str, DataFrame] | None:
        raise NotImplementedError


def unit(function: Transform, outputs: Iterable[str] = ("OUTPUT",)) -> Unit:
    """A unit of a function: its parameters are the inputs."""
    made = Unit()
    made.inputs = tuple(inspect.signature(function).parameters)
    made.outputs = tuple(outputs)
    made.transform = function  # type: ignore[method-assign]
    return made


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = df.transform(s)
        return df

    return run


class Collection:
    """Components that belong together, with edges between their streams and aliases at the boundary."""

    def components(self) -> dict[str, Unit | Collection]:
        return {}

    def network(self) -> Iterable[tuple[Any, Any]]:
        return ()

    def configure(self) -> None:
        """Runs once the edges are known."""


class Pipeline:
    """Named units and the edges between their streams, topics included."""

    def __init__(self, components: dict[str, Unit | Collection], connections: Iterable[tuple[Any, Any]] = ()):
        self.units: dict[str, Unit] = {}
        self.edges: list[tuple[str, str]] = [(topic_name(a), topic_name(b)) for a, b in connections]
        for name, c in components.items():
            self._add(name, c)
        self.order()

    def _add(self, path: str, c: Unit | Collection) -> None:
        if isinstance(c, Unit):
            self.units[path] = c
            return
        for name, inner in c.components().items():
            self._add(f"{path}/{name}", inner)
        self.edges += [(f"{path}/{topic_name(a)}", f"{path}/{topic_name(b)}") for a, b in c.network()]
        c.configure()

    def _graph(self) -> dict[str, set[str]]:
        before: dict[str, set[str]] = defaultdict(set)
        for a, b in self.edges:
            before[b].add(a)
        for name, u in self.units.items():
            for o in u.outputs:
                before[f"{name}/{o}"].add(name)
            before[name] |= {f"{name}/{i}" for i in u.inputs}
        return before

    def order(self) -> list[str]:
        """Streams and units, each after all that it needs; a cycle raises."""
        try:
            return list(TopologicalSorter(self._graph()).static_order())
        except CycleError as e:
            raise ValueError(f"the connections have a cycle: {e.args[1]}") from e

    def streams(self, sources: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """The DataFrame of every topic and stream that something reaches.

        A stream's publishers are a set: one that comes by several ways is
        delivered once.  Several publishers are united.
        """
        origin: dict[str, dict[str, DataFrame]] = {topic_name(k): {topic_name(k): v} for k, v in (sources or {}).items()}
        before = self._graph()
        for node in self.order():
            if node in self.units:
                u = self.units[node]
                given = {i: united(origin.get(f"{node}/{i}", {})) for i in u.inputs}
                if any(v is None for v in given.values()):
                    continue
                made = u.transform(**given)
                made = made if isinstance(made, dict) else {} if made is None else {u.outputs[0]: made}
                for o, df in made.items():
                    origin[f"{node}/{o}"] = {f"{node}/{o}": df}
            else:
                own = dict(origin.get(node, {}))
                for a in before.get(node, ()):
                    if a not in self.units:
                        own |= origin.get(a, {})
                if own:
                    origin[node] = own
        return {k: df for k, v in origin.items() if (df := united(v)) is not None}

    def run(self, sources: dict[str, DataFrame] | None = None, sinks: dict[str, Callable[[DataFrame], Any]] | None = None) -> dict[str, Any]:
        """Gives each sink its stream: batch results, or streaming queries that it starts."""
        streams = self.streams(sources)
        return {k: f(streams[topic_name(k)]) for k, f in (sinks or {}).items()}

    def metadata(self) -> list[dict[str, Any]]:
        """A record for each unit, by address."""
        return [{"address": n, "type": type(u).__name__, "inputs": list(u.inputs), "outputs": list(u.outputs), "settings": repr(u.settings)} for n, u in sorted(self.units.items())]


def united(parts: dict[str, DataFrame]) -> DataFrame | None:
    out = None
    for name in sorted(parts):
        out = parts[name] if out is None else out.unionByName(parts[name], allowMissingColumns=True)
    return out


def stop_all(queries: Iterable[StreamingQuery]) -> None:
    for q in queries:
        q.stop()
