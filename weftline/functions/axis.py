"""Axes as column expressions: linear ones by gain and offset, others by their coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDINGS = {"rint": F.rint, "floor": F.floor, "ceil": F.ceil}


def _col(x: Column | float | str) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def axis_value(index: Column | str, gain: Column | float = 1.0, offset: Column | float = 0.0) -> Column:
    """Value at a place of a linear axis."""
    return _col(index) * _col(gain) + _col(offset)


def axis_index(value: Column | str, gain: Column | float = 1.0, offset: Column | float = 0.0, rounding: str = "rint") -> Column:
    """Place of a value on a linear axis; rint takes halves to even."""
    return ROUNDINGS[rounding]((_col(value) - _col(offset)) / _col(gain)).cast("long")


def time_axis(fs: Column | float, offset: Column | float = 0.0) -> Column:
    """A linear axis in seconds for a sampling rate."""
    return F.struct(F.lit("linear").alias("kind"), F.lit("s").alias("unit"), (F.lit(1.0) / _col(fs)).alias("gain"), _col(offset).cast("double").alias("offset"))


def axis_values(n: Column | int, gain: Column | float = 1.0, offset: Column | float = 0.0) -> Column:
    """All values of a linear axis of n places."""
    n = _col(n)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: axis_value(i.cast("double"), gain, offset))


def coordinate(coords: Column | str, index: Column | str) -> Column:
    """Value at a place of an axis with explicit coordinates; null beyond its ends."""
    return F.get(_col(coords), _col(index).cast("int"))
