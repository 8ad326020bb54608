"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, quoted


class Postings:
    """Inverted lists of a block of integer rows: for each term the rows that hold it, and their weights."""

    def __init__(self, lengths: np.ndarray, values: np.ndarray):
        self.n = len(lengths)
        starts = np.cumsum(lengths) - lengths
        row = np.repeat(np.arange(self.n), lengths)
        term = np.arange(len(values)) - np.repeat(starts, lengths)
        keep = values != 0
        row, term, values = row[keep], term[keep], values[keep]
        order = np.argsort(term, kind="stable")
        self.rows, self.weights = row[order], values[order]
        self.bounds = np.searchsorted(term[order], np.arange(int(lengths.max(initial=0)) + 1))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Dense scores of one sparse query row; terms that nobody holds add nothing."""
        acc = np.zeros(self.n, np.int64)
        for t in np.flatnonzero(query[: len(self.bounds) - 1]):
            a, b = self.bounds[t], self.bounds[t + 1]
            if b - a == self.n:  # everyone holds the term: rows are 0..n-1
                acc += query[t] * self.weights[a:b]
            else:
                acc[self.rows[a:b]] += query[t] * self.weights[a:b]
        return acc


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids; unordered."""
    if len(scores) <= k:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > edge)
    equal = np.flatnonzero(scores == edge)
    return np.concatenate([above, equal[np.argsort(ids[equal], kind="stable")[: k - len(above)]]])


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return lengths, column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


#: A cell has so many rows at least, where rows are dealt finer to occupy all cores.
LEAST_ROWS = 1024
#: Partitions of the exchange at most; beyond, a task works on one cell after another.
MOST_PARTS = 1 << 14


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0, query_block: int = 1 << 15, row_block: int = 1 << 16) -> DataFrame:
    """The k rows of highest inner product for each query row, among all rows but the query's own.

    A component x counts as floor(scale * x).  Query rows and candidate rows
    are dealt into blocks of about query_block and row_block rows at most, and
    into at least three cells for each core where there are rows enough; each
    pair of blocks is a cell of its own, where the candidates become postings
    and each query scatters its weighted postings into a dense score array and
    selects its k best.  The cells' lists merge by rank.  No side is broadcast.
    Rows are numbered once, in a table in the shared folder, so a lost task
    deals them as before, and equal rows are spread like others.

    Rows whose id or vector is null, or whose vector holds null or non-finite
    components, take no part.  Vectors of other lengths, empty ones too, count
    as filled up with zeros.  Ties go to the smaller id.  Repeated rows are
    candidates each; a row is a query's own if its id is equal, and queries
    with the same id pool their lists.  Components beyond 64 bits saturate;
    sums are modulo 2^64.  An empty table, or one without queries, gives an
    empty result.  Other columns play no part, whatever they are called.

    Returns query_id, rank (from 1), vec_id, score.
    """
    spark = vectors.sparkSession
    vector = F.col(quoted(vec_col))
    clean = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = cut(
        vectors.where(F.col(quoted(id_col)).isNotNull() & vector.isNotNull() & clean).select(
            F.col(quoted(id_col)).cast("long").alias("id"),
            F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("terms"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
            F.monotonically_increasing_id().alias("nth"),
        )
    )
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    cores = spark.sparkContext.defaultParallelism
    down = max(1, math.ceil(asked / query_block))
    across = max(1, math.ceil(n / row_block), min(math.ceil(3 * cores / down), n // LEAST_ROWS))
    parts = min(down * across, MOST_PARTS)
    dealt = lambda salt, blocks: F.pmod(F.xxhash64(F.lit(salt), "nth"), F.lit(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    queries = rows.where("asks").select(dealt(0, down).alias("qb"), every(across).alias("rb"), F.lit(True).alias("asks"), "id", "terms")
    found = rows.select(every(down).alias("qb"), dealt(1, across).alias("rb"), F.lit(False).alias("asks"), "id", "terms")
    both = queries.unionByName(found).select((F.col("qb") * across + F.col("rb")).alias("cell"), "asks", "id", "terms")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists of one cell."""
        cell = pa.Table.from_batches(held)
        asking, having = cell.filter(cell["asks"]), cell.filter(pc.invert(cell["asks"]))
        if not asking.num_rows or not having.num_rows:
            return
        ids = having["id"].to_numpy()
        postings = Postings(*_lists(having["terms"]))
        lengths, values = _lists(asking["terms"])
        ends = np.cumsum(lengths)
        out = []
        for q, a, b in zip(asking["id"].to_numpy(), ends - lengths, ends, strict=True):
            scores = postings.scores(values[a:b])
            other = np.flatnonzero(ids != q)
            top = other[best(scores[other], ids[other], k)]
            out.append((np.full(len(top), q), ids[top], scores[top]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            cell = b["cell"].to_numpy()
            edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i < j and held and held[-1]["cell"][0].as_py() != cell[i]:
                    yield from solve(held)
                    held = []
                if i < j:
                    held.append(b.slice(i, j - i))
        if held:
            yield from solve(held)

    exchanged = both.withColumn("part", F.pmod("cell", F.lit(parts)).cast("int")).repartitionById(parts, "part")
    lists = exchanged.select("cell", "asks", "id", "terms").sortWithinPartitions("cell").mapInArrow(run, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
