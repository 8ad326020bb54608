"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, fan_out, fresh, quoted, without

#: The library's own draw takes populations below this.
MOST = 10**9


def log_poisson(x: int, over: int, under: int) -> float:
    """log P(X = x) of a Poisson variable of mean over / under: Stirling's series and a deviance that keeps its digits however large x is."""
    mean = over / under
    if x == 0:
        return -mean
    if x < 16:
        return x * math.log(mean) - mean - math.lgamma(x + 1)
    apart = (x * under - over) / under  # from whole numbers, so nothing cancels
    ratio = apart / (x + mean)
    if abs(ratio) < 0.1:
        deviance, power, k = apart * ratio, 2 * x * ratio, 1
        while deviance + (more := (power := power * ratio * ratio) / (2 * k + 1)) != deviance:
            deviance, k = deviance + more, k + 1
    else:
        deviance = x * math.log(x / mean) - apart
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / x**2) / x**2) / x**2) / x
    return -deviance - series - 0.5 * math.log(2 * math.pi * x)


def hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n drawn from good + bad are good; exact for populations of any size.

    Beyond what the library takes, by rejection from a bound that holds for
    every log-concave distribution around its mode.
    """
    total = good + bad
    if not n or not good:
        return 0
    if not bad or n == total:
        return min(n, good)
    if total < MOST:
        return int(draw.hypergeometric(good, bad, n))

    def cells(k: int) -> float:
        return log_poisson(k, good * n, total) + log_poisson(good - k, good * (total - n), total) + log_poisson(n - k, bad * n, total) + log_poisson(bad - n + k, bad * (total - n), total)

    least, most = max(0, n - bad), min(n, good)
    mode = min(most, max(least, (n + 1) * (good + 1) // (total + 2)))
    at_mode = cells(mode)
    margins = sum(log_poisson(x, x, 1) for x in (good, bad, n, total - n)) - log_poisson(total, total, 1)
    p = math.exp(at_mode - margins)
    width = 1 + p / 2
    while True:
        flat = draw.random() <= width / (1 + width)
        y = draw.random() * width / p if flat else (width + draw.standard_exponential()) / p
        k = mode + (1 if draw.random() < 0.5 else -1) * round(y)
        if least <= k <= most and math.log1p(-draw.random()) + min(0.0, width - p * y) <= cells(k) - at_mode:
            return k


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """rows[p] rows of each part dealt over shards: every uniform deal is equally likely, sums are exact, whatever the numbers."""
    total = sum(rows)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    draw = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((len(rows), shards), np.int64)
    for p, n in enumerate(rows):
        rest = sum(left)
        for s in range(shards):  # the shards one by one, from what later ones have left
            rest -= left[s]
            k = hypergeometric(draw, left[s], rest, n)
            out[p, s] = k
            left[s] -= k
            n -= k
    return out


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def shuffle_into_shards(docs: DataFrame, shards: int = 16, seed: int = 17, key_cols: tuple[str, ...] = ("doc_id", "text_crc32"), parts: int | None = None) -> DataFrame:
    """docs plus shard and slot: shards differ by one row at most, and the order is a uniform shuffle.

    Rows fall into parts by a hash of key_cols.  For each part the driver draws
    how many of its rows go to each shard: a multivariate hypergeometric draw
    from what the shards still lack (a matrix of parts x shards counts, all
    that the driver ever holds).  A seeded local permutation ranks each part
    and cuts it at those counts; rows are exchanged; a second seeded
    permutation within cells of a shard, laid end to end, gives gapless slots.
    The dealt rows are written to the shared folder once, so docs is read twice,
    the first time for key_cols alone.

    Rows equal in key_cols differ in nothing that decides, and are spread like
    others: ties are broken by the columns of docs, so only rows equal
    throughout are interchangeable.  Null keys count as a value.  Texts of any
    length are columns like others.  An empty table gives an empty one.  shard
    and slot replace columns of those names; others may have any name.
    """
    spark = docs.sparkSession
    parts = parts or fan_out(spark)
    columns = without(docs, "shard", "slot")
    docs = docs.select(*map(quoted, columns))
    plain = [F.col(quoted(c)) for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    part, ends, nth, mixed, cell, at, row = fresh(docs, "part", "ends", "nth", "mixed", "cell", "at", "row")
    hashed = lambda salt: F.xxhash64(F.lit(seed * 4 + salt), *map(quoted, key_cols))
    dealt = docs.withColumn(part, F.pmod(hashed(0), F.lit(parts)).cast("int"))
    counts = dict(dealt.groupBy(part).count().collect())
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], shards, seed)
    cuts = _table(spark, [(p, [int(x) for x in c]) for p, c in enumerate(np.cumsum(matrix, axis=1))], f"{part} int, {ends} array<long>")
    local = Window.partitionBy(part).orderBy(hashed(1), *plain)
    placed = (
        dealt.withColumn(nth, F.row_number().over(local))
        .join(F.broadcast(cuts), part)  # the matrix
        .withColumn("shard", F.size(F.filter(ends, lambda e: e < F.col(nth))))
        .withColumn(mixed, hashed(2))
        .withColumn(cell, F.pmod(F.shiftrightunsigned(mixed, 16), F.lit(parts)).cast("int"))
    )
    placed = cut(placed.select(*map(quoted, columns), "shard", mixed, cell))
    held = {(s, c): n for s, c, n in placed.groupBy("shard", cell).count().collect()}
    offsets = []
    for s in range(shards):
        before = 0
        for c in range(parts):
            offsets.append((s, c, before))
            before += held.get((s, c), 0)
    starts = _table(spark, offsets, f"shard int, {cell} int, {at} long")
    again = Window.partitionBy("shard", cell).orderBy(mixed, *plain)
    return (
        placed.withColumn(row, F.row_number().over(again))
        .join(F.broadcast(starts), ["shard", cell])  # as large as the matrix
        .withColumn("slot", F.col(at) + F.col(row) - 1)
        .select(*map(quoted, columns), "shard", "slot")
    )
