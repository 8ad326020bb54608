"""Log lines, encoded arrays and settings as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

START = "__start__"


def log_line(ts: Column, obj: Column) -> Column:
    """{"ts": epoch seconds, "obj": ...}"""
    return F.to_json(F.struct(ts.cast("double").alias("ts"), obj.alias("obj")))


def log_fields(line: Column, schema: str) -> Column:
    """struct<ts, obj> of a log line; null where it is no JSON.  Types named in data are never imported."""
    return F.from_json(line, f"ts double, obj {schema}", {"mode": "PERMISSIVE"})


# The fields of an encoded array in a log.
ARRAY_TYPE, ARRAY_FIELDS = "ndarray", "`__type__` string, data string, dtype string, shape array<int>"


def encoded_array(data: Column, kind: str = "<f8") -> Column:
    """Base64 of an array<double>'s contiguous bytes, in this dtype."""
    return F.base64(_bytes(kind)(data))


def decoded_array(text: Column, kind: Column | str = "<f8") -> Column:
    """array<double> of Base64 bytes of this dtype, which may be a column."""
    return _numbers()(F.unbase64(text), F.lit(kind) if isinstance(kind, str) else kind)


def encoded_ndarray(data: Column, shape: Column, kind: str = "<f8") -> Column:
    """struct of type, data, dtype and shape: an array as log lines hold it."""
    return F.struct(F.lit(ARRAY_TYPE).alias("__type__"), encoded_array(data, kind).alias("data"), F.lit(kind).alias("dtype"), shape.cast("array<int>").alias("shape"))


def decoded_ndarray(encoded: Column) -> Column:
    """struct<data array<double>, dtype, shape> of an encoded array; null where it is none, or its bytes do not fill its shape."""
    data = decoded_array(encoded["data"], encoded["dtype"])
    size = F.aggregate(encoded["shape"], F.lit(1).cast("long"), lambda a, n: a * n)
    fits = (encoded["__type__"] == ARRAY_TYPE) & (F.size(data) == size)
    return F.when(fits, F.struct(data.alias("data"), encoded["dtype"].alias("dtype"), encoded["shape"].alias("shape")))


def _bytes(kind: str):
    """Bytes of each array: a batch's numbers are cast at once and cut at the arrays' ends."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        width = np.dtype(kind).itemsize
        for a in batches:
            numbers = a.flatten()
            whole = numbers.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(kind).tobytes()
            sizes = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)]) * width
            found = pa.Array.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(whole)]).cast(pa.binary())
            yield pc.if_else(a.is_null(), pa.scalar(None, pa.binary()), found)

    return run


def _numbers():
    """Numbers of each row's bytes: rows of one dtype are cast at once.  Bytes that are no whole numbers, and what is no dtype of plain numbers, give null."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for data, kinds in batches:
            lengths = pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False)
            parts: list[np.ndarray] = []
            at = np.full(len(data), -1, np.int64)
            place = 0
            for kind in kinds.unique().drop_null().to_pylist():
                try:
                    one = np.dtype(kind)
                except TypeError:
                    continue
                if one.kind not in "biuf":
                    continue
                which = np.flatnonzero(pc.fill_null(pc.equal(kinds, kind), False).to_numpy(zero_copy_only=False) & (lengths % one.itemsize == 0) & data.is_valid().to_numpy(zero_copy_only=False))
                numbers = np.frombuffer(b"".join(data.take(pa.array(which)).to_pylist()), one).astype(np.float64)
                sizes = lengths[which] // one.itemsize
                at[which] = place + np.cumsum(sizes) - sizes
                place += len(numbers)
                parts.append(numbers)
            whole = np.concatenate([np.empty(0), *parts])
            widths = np.array([np.dtype(k).itemsize if a >= 0 else 1 for k, a in zip(kinds.to_pylist(), at.tolist(), strict=True)], np.int64)
            sizes = np.where(at >= 0, lengths // widths, 0)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            order = np.repeat(at - ends[:-1], sizes) + np.arange(ends[-1])
            lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(whole[order]))
            yield pc.if_else(pa.array(at < 0), pa.scalar(None, lists.type), lists).cast(pa.list_(pa.float64()))

    return run


def with_setting(settings: Column, path: str, value: Column) -> Column:
    """settings with one field set, by its dotted path; an unknown field is an analysis error."""
    return settings.withField(path, value)


def merged(base: Column, patch: Column) -> Column:
    """A map with the patch's keys put over it."""
    keys = F.array_union(F.map_keys(base), F.map_keys(patch))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.when(F.map_contains_key(patch, k), F.element_at(patch, k)).otherwise(F.element_at(base, k))))
