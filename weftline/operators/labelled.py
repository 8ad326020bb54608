"""A labelled array: a long frame of elements, and the names, lengths and axes of its dimensions beside it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import arrays


@dataclass(frozen=True)
class Linear:
    """Places at equal steps."""

    gain: float = 1.0
    offset: float = 0.0
    unit: str = ""

    def at(self, place: Column) -> Column:
        return place.cast("double") * self.gain + self.offset

    def values(self, length: int) -> list[float]:
        return [i * self.gain + self.offset for i in range(length)]


@dataclass(frozen=True)
class Coordinates:
    """A label for each place."""

    labels: tuple
    unit: str = ""

    def at(self, place: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.labels)), place.cast("int"))

    def values(self, length: int) -> list:
        return list(self.labels)


Axis = Linear | Coordinates


@dataclass(frozen=True)
class Labelled:
    """frame has columns that tell arrays apart, a place (from 0) for each of dims, and value.

    shape holds the lengths of dims.  axes may name dimensions and others; a
    dimension without an axis counts as Linear().  key is the stream's name.
    Metadata lives on the driver and is as small as the array has dimensions
    and labels; elements stay in the frame.
    """

    frame: DataFrame
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    axes: dict[str, Axis] = field(default_factory=dict)
    key: str = ""

    def __post_init__(self) -> None:
        if len(set(self.dims)) != len(self.dims) or len(self.dims) != len(self.shape):
            raise ValueError("dims must be unique, one for each length of the shape")
        for d, a in self.axes.items():
            if isinstance(a, Coordinates) and d in self.dims and len(a.labels) != self.length(d):
                raise ValueError(f"{d} has {self.length(d)} places and {len(a.labels)} labels")

    def place(self, dim: str | int) -> int:
        """Number of a dimension, given its name or number."""
        if isinstance(dim, int):
            return range(len(self.dims))[dim]
        if dim not in self.dims:
            raise ValueError(f"{dim} not present in {self.dims}")
        return self.dims.index(dim)

    def name(self, dim: str | int) -> str:
        return self.dims[self.place(dim)]

    def length(self, dim: str | int) -> int:
        return self.shape[self.place(dim)]

    def axis(self, dim: str | int) -> Axis:
        """The axis of that name or number; a dimension that has none is linear from 0 in steps of 1."""
        if isinstance(dim, str) and dim in self.axes:
            return self.axes[dim]
        return self.axes.get(self.name(dim), Linear())

    def values(self, dim: str | int) -> list:
        """Labels of all places of a dimension."""
        return self.axis(dim).values(self.length(dim))

    def isel(self, **indexers: int | slice | Sequence[int]) -> Labelled:
        """Places of dimensions by number; an int keeps the dimension, of length 1.  Axes follow."""
        out = self
        for dim, index in indexers.items():
            at, n = out.place(dim), out.length(dim)
            chosen = list(range(n)[index]) if isinstance(index, slice) else [range(n)[i] for i in ([index] if isinstance(index, int) else index)]
            axes = dict(out.axes)
            if isinstance(own := axes.get(dim), Linear):
                axes[dim] = replace(own, offset=arrays.isel_offset(own.offset, own.gain, index, n))
            elif isinstance(own, Coordinates):
                axes[dim] = replace(own, labels=tuple(own.labels[i] for i in chosen))
            shape = (*out.shape[:at], len(chosen), *out.shape[at + 1 :])
            out = replace(out, frame=arrays.isel(out.frame, dim, index, n), shape=shape, axes=axes)
        return out

    def sel(self, **ranges: slice) -> Labelled:
        """Places of linear dimensions by label: nearest places, the stop left out."""
        out = self
        for dim, wanted in ranges.items():
            own = out.axis(dim)
            if not isinstance(own, Linear):
                raise ValueError(f"{dim} is not linear")
            place = lambda v: None if v is None else max(0, round((v - own.offset) / own.gain))  # noqa: B023, E731
            step = None if wanted.step is None else max(1, int(wanted.step / own.gain))
            out = out.isel(**{dim: slice(place(wanted.start), place(wanted.stop), step)})
        return out

    def transpose(self, order: Sequence[str] | None = None) -> Labelled:
        order = tuple(order or reversed(self.dims))
        return replace(self, frame=arrays.transpose(self.frame, self.dims, order), dims=order, shape=tuple(self.length(d) for d in order))

    def with_labels(self, suffix: str = "_label") -> DataFrame:
        """The frame plus each dimension's label: what is handed to libraries outside Spark."""
        return self.frame.withColumns({f"{d}{suffix}": self.axis(d).at(F.col(d)) for d in self.dims})


def concatenate(*parts: Labelled, dim: str, axis: Axis | None = None, filter_key: str | None = None) -> Labelled:
    """Arrays end to end along a dimension they have, or stacked along a new one, which then comes first.

    filter_key: only the arrays of that key take part.  All need the same dims,
    and other lengths that agree.  The dimension gets the axis given; else the
    labels of all end to end where all have coordinates; else the first one's
    axis.  The key stays where all agree; else it is empty.  Nothing is
    computed: lengths and axes are metadata.
    """
    if filter_key is not None:
        parts = tuple(p for p in parts if p.key == filter_key)
    if not parts:
        raise ValueError("nothing to concatenate")
    first, new = parts[0], dim not in parts[0].dims
    if any(p.dims != first.dims for p in parts):
        raise ValueError("objects have incompatible dims")
    if any(p.length(d) != first.length(d) for p in parts for d in first.dims if d != dim):
        raise ValueError("lengths of the other dimensions differ")
    axes = dict(first.axes)
    own = [p.axes.get(dim) for p in parts]
    if axis is not None:
        axes[dim] = axis
    elif all(isinstance(a, Coordinates) for a in own):
        axes[dim] = replace(own[0], labels=tuple(x for a in own for x in a.labels))
    lengths = [1 if new else p.length(dim) for p in parts]
    frame = arrays.concatenate([p.frame for p in parts], dim, lengths, new)
    dims = (dim, *first.dims) if new else first.dims
    shape = tuple(sum(lengths) if d == dim else first.length(d) for d in dims)
    return Labelled(frame, dims, shape, axes, first.key if all(p.key == first.key for p in parts) else "")
