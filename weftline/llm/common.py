"""What several operators share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = b" \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew if its rows lie in fewer partitions than there are cores, as those of a file that cannot be split do."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    found = df.select(F.spark_partition_id().alias("part")).distinct().count()  # reads no column
    return df.repartition(cores) if 0 < found < cores else df


def fan_out(spark: SparkSession) -> int:
    """Partitions of a shuffle that an operator deals out itself: as many as Spark's own."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, as the session names it; a local one serves a local master only, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs start there, whatever executors are lost."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/weftline-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> list[str]:
    """Columns of df other than these, whatever their case."""
    return [c for c in df.columns if c.lower() not in {n.lower() for n in names}]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    column = column.cast(pa.large_binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to most at most; one that is larger stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def pieces(batches: Iterator[pa.RecordBatch], column: int | str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batches, so many at once that the texts of a column take most bytes at most; one that is longer stands alone."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        for i, j in slices(sizes, most):
            yield b.slice(i, j - i)
    pa.default_memory_pool().release_unused()  # the worker lives on


U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words: xor-shifts and odd multipliers."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


#: Keys of the hashes: fixed odd words, the same in every run.
K1, K2, K3 = U64(0x8B72E5D9F6A3C4E1), U64(0xC2B2AE3D27D4EB4F), U64(0xA24BAED4963EE407)
#: A random 64-bit word for each byte value.
BYTE_WORDS = mix64(np.arange(1, 257, dtype=U64) * K3)


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair (x, y).  Shifts and products alternate, so no string's structure passes through."""
    z = x >> U64(31)
    z ^= x
    z *= K1
    z += y * K2
    z ^= z >> U64(29)
    z *= K3
    z ^= z >> U64(32)
    return z


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of data[i : i + width] for each i."""
    return joined_windows(BYTE_WORDS[data], width)


def joined_windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of h[i : i + width] for each i: windows of doubled width from both halves, then those that add up to width."""
    items, size, whole, done = len(h), 1, None, 0
    while True:
        if width & size:
            if whole is None:
                whole, done = h, size
            else:
                n = max(0, items - done - size + 1)
                whole, done = joined(whole[:n], h[done : done + n]), done + size
        if done == width:
            return whole
        n = max(0, len(h) - size)
        h, size = joined(h[:n], h[size : size + n]), 2 * size


#: Longer ranges are hashed one by one.
LONG = 64


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each pair, eight bytes a step; of long ranges by BLAKE2b."""
    sizes = end - start
    h = mix64(sizes.astype(U64) * K3)
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
    live = np.flatnonzero(sizes <= LONG)
    for at in range(0, LONG, 8):
        live = live[sizes[live] > at]
        if not len(live):
            break
        h[live] = joined(h[live], eight[start[live] + at] & masks[np.minimum(sizes[live] - at, 8)])
    for i in np.flatnonzero(sizes > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def id_remainder(column: str, mod: int):
    """crc32 of the id's text, modulo mod; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(mod))


def sample_by_id(rows: DataFrame, most: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """The rows of the `most` ids of smallest hash: first the ids alone, then their rows.

    The broadcast side is those ids, so its size has a bound.
    """
    ids = rows.where(F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(most)
    return rows.join(F.broadcast(ids), id_col, "left_semi")
