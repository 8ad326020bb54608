"""Labelled N-d arrays.

Two forms: packed, a row for each array with its data in row-major order; and
long, a row for each element with a column for the place on each dimension.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def failed(message: str, kind: DataType | str) -> Column:
    """An error in the place of an array; read from text, as generated code takes no cast of it."""
    return F.from_json(F.raise_error(F.lit(message)).cast("string"), kind)


def strides(shape: Sequence[int]) -> list[int]:
    return [math.prod(shape[i + 1 :]) for i in range(len(shape))]


def to_long(df: DataFrame, keys: Sequence[str], data: str, shape: Sequence[int], dims: Sequence[str], value: str = "value") -> DataFrame:
    """A row for each element.  The data must have as many elements as the shape says."""
    if len(set(dims)) != len(dims) or len(dims) != len(shape):
        raise ValueError("dims must be unique, one for each length of the shape")
    checked = F.when(F.size(data) == math.prod(shape), F.col(data)).otherwise(failed("data does not fit its shape", df.schema[data].dataType))
    out = df.select(*keys, F.posexplode(checked).alias("_i", value))
    places = [F.pmod(F.floor(F.col("_i") / s), F.lit(n)).cast("int").alias(d) for d, n, s in zip(dims, shape, strides(shape), strict=True)]
    return out.select(*keys, *places, value)


def to_packed(df: DataFrame, keys: Sequence[str], dims: Sequence[str], value: str = "value", data: str = "data") -> DataFrame:
    """Arrays again: elements in row-major order of dims.  One array must fit a task."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*dims, value))), lambda x: x[value]).alias(data))


def isel(df: DataFrame, dim: str, index: int | slice | Sequence[int], length: int) -> DataFrame:
    """Places of a dimension by number, re-indexed from 0.  An int keeps the dimension, of length 1."""
    if isinstance(index, slice):
        chosen = range(length)[index]
    else:
        chosen = [range(length)[i] for i in ([index] if isinstance(index, int) else index)]
    if not len(chosen):
        raise IndexError(f"nothing selected of {dim}")
    if isinstance(chosen, range) and chosen.step > 0:
        at = F.col(dim) - chosen.start
        return df.where((at >= 0) & (F.col(dim) < chosen.stop) & (at % chosen.step == 0)).withColumn(dim, (at / chosen.step).cast("int"))
    places = F.array(*[F.lit(i) for i in chosen])
    hits = F.filter(F.transform(places, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: x["p"] == F.col(dim))
    return df.where(F.col(dim).isin(*chosen)).withColumn("_hit", F.explode(hits)).withColumn(dim, F.col("_hit.i").cast("int")).drop("_hit")


def isel_offset(offset: float, gain: float, index: int | slice | Sequence[int], length: int) -> float:
    """Offset of a linear axis after isel; the gain stays, also for steps."""
    first = range(length)[index][0] if isinstance(index, slice) else range(length)[index if isinstance(index, int) else index[0]]
    return offset + first * gain


def sel(df: DataFrame, dim: str, start: float | None, stop: float | None, length: int, gain: float = 1.0, offset: float = 0.0, step: float | None = None) -> DataFrame:
    """Places of a linear dimension by label: nearest places, the stop left out.

    Labels before the axis count as its start, rather than from its end.
    """
    place = lambda v: max(0, round((v - offset) / gain))  # noqa: E731  Python rounds halves to even
    return isel(df, dim, slice(None if start is None else place(start), None if stop is None else place(stop), None if step is None else max(1, int(step / gain))), length)


def slice_along(df: DataFrame, dim: str, index: int | slice, length: int) -> DataFrame:
    """Like isel, but an int drops the dimension."""
    if dim not in df.columns:
        raise ValueError(f"no dimension {dim}")
    out = isel(df, dim, index, length)
    return out.drop(dim) if isinstance(index, int) else out


def transpose(df: DataFrame, dims: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Dimensions in another order, reversed by default; other columns stay before them."""
    order = list(order or reversed(dims))
    if sorted(order) != sorted(dims):
        raise ValueError("order must name each dimension once")
    keys = [c for c in df.columns if c not in (*dims, "value")]
    return df.select(*keys, *order, "value")


def transpose_packed(data: Column, shape: Sequence[int], order: Sequence[int]) -> Column:
    """Row-major data with dimensions in another order, by index arithmetic."""
    new = [shape[i] for i in order]
    old = strides(shape)
    at = lambda i: sum((F.pmod(F.floor(i / s), F.lit(n)) * old[d] for d, n, s in zip(order, new, strides(new), strict=True)), F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(math.prod(shape) - 1)), lambda i: F.get(data, at(i).cast("int")))


def as_2d(df: DataFrame, dims: Sequence[str], shape: Sequence[int], dim: str) -> DataFrame:
    """row on one dimension, col over all others in row-major order."""
    rest = [(d, n) for d, n in zip(dims, shape, strict=True) if d != dim]
    col = sum((F.col(d) * s for (d, _), s in zip(rest, strides([n for _, n in rest]), strict=True)), F.lit(0))
    return df.select(*[c for c in df.columns if c not in dims and c != "value"], F.col(dim).alias("row"), col.cast("int").alias("col"), "value")


def shape_2d(shape: Column, axis: int) -> Column:
    """Length of one dimension and the product of the others."""
    n = F.get(shape, F.lit(axis))
    rest = F.aggregate(F.transform(shape, lambda x, i: F.when(i == axis, F.lit(1)).otherwise(x)).cast("array<long>"), F.lit(1).cast("long"), lambda a, x: a * x)
    return F.struct(n.cast("long").alias("rows"), rest.alias("cols"))


def iter_over(df: DataFrame, dim: str, name: str | None = None) -> DataFrame:
    """One array for each place of a dimension: the place becomes part of the key."""
    return df.withColumnRenamed(dim, name or f"{dim}_index")


def concatenate(parts: Sequence[DataFrame], dim: str, lengths: Sequence[int], new: bool = False) -> DataFrame:
    """Long arrays joined along a dimension: appended along one they have, or stacked along a new one.

    A column key stays only where all parts agree; else it is empty.  That is a
    subquery of the plan: nothing is computed here.
    """
    out = None
    for i, part in enumerate(parts):
        place = F.lit(i) if new else F.col(dim) + sum(lengths[:i])
        part = part.withColumn(dim, place.cast("int"))
        out = part if out is None else out.unionByName(part)
    assert out is not None
    if "key" in out.columns:
        one = out.agg(F.when(F.min("key") == F.max("key"), F.min("key")).otherwise("").alias("key")).scalar()
        out = out.withColumn("key", one)
    return out


def sliding_windows(data: Column | str, width: int, step: int = 1) -> Column:
    """array of windows of an array: none if it is just too short, an error beyond that."""
    data = F.col(data) if isinstance(data, str) else data
    n = F.size(data)
    empty = F.slice(F.array(data), 1, 0)
    if width == 0:
        return empty
    some = F.transform(F.sequence(F.lit(0), n - width, F.lit(step)), lambda i: F.slice(data, i + 1, width))
    return F.when(n < width - 1, failed("window is longer than the array", "array<array<double>>")).when(n < width, empty).otherwise(some)


def sliding_windows_long(df: DataFrame, keys: Sequence[str], dim: str, width: int, step: int = 1, length: int | None = None) -> DataFrame:
    """win and the place within it instead of a dimension: each element goes to the windows that hold it, without a shuffle."""
    last = (length - width) // step if length is not None else None
    if last is None:
        raise ValueError("length is needed")
    first = F.greatest(F.lit(0), F.ceil((F.col(dim) - width + 1) / step)).cast("int")
    final = F.least(F.lit(last), F.floor(F.col(dim) / step)).cast("int")
    out = df.where(first <= final).withColumn("win", F.explode(F.sequence(first, final)))
    return out.withColumn(dim, (F.col(dim) - F.col("win") * step).cast("int"))


def chunks(data: Column | str, size: int, fs: float = 1000.0, tzero: float = 0.0) -> Column:
    """array of struct<chunk, offset, data>; the last may be short."""
    data = F.col(data) if isinstance(data, str) else data
    numbers = F.when(F.size(data) > 0, F.sequence(F.lit(0), F.ceil(F.size(data) / size).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.struct(i.alias("chunk"), (i * size / F.lit(fs) + tzero).alias("offset"), F.slice(data, i * size + 1, size).alias("data")))


def chunk_rows(df: DataFrame, order_by: str, size: int, keys: Sequence[str] = (), dense: bool = False) -> DataFrame:
    """df plus chunk and place.  dense: order_by counts rows from 0, and no order must be found."""
    if dense:
        at = F.col(order_by)
    else:
        at = F.row_number().over(Window.partitionBy(*keys).orderBy(order_by)) - 1
    return df.withColumn("chunk", F.floor(at / size).cast("long")).withColumn("place", F.pmod(at, F.lit(size)).cast("int"))


def rename_dims(df: DataFrame, names: dict[str, str | None]) -> DataFrame:
    """Dimensions renamed; None drops one, which must have length 1."""
    for old, new in names.items():
        if new is None:
            rest = [c for c in df.columns if c != old]
            fits = F.when(F.col(old) == 0, F.lit(True)).otherwise(F.raise_error(F.lit(f"{old} is longer than 1")).cast("boolean"))
            df = df.where(fits).select(*rest)
        else:
            df = df.withColumnRenamed(old, new)
    return df


def elementwise(data: Column | str, *steps) -> Column:
    """An array's elements through functions one after another."""
    data = F.col(data) if isinstance(data, str) else data
    for f in steps:
        data = F.transform(data, f)
    return data


def arrays_equal(dims_a: Column, data_a: Column, dims_b: Column, data_b: Column) -> Column:
    return dims_a.eqNullSafe(dims_b) & data_a.eqNullSafe(data_b)
