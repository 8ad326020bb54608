"""Exact deduplication by Grace hashing: spill files until each bucket fits a table that compares whole content."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from typing import IO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import WHITE, batch, fan_out, pieces, texts

#: content, rows, (code points, doc_id) of the best row
Entry = tuple[bytes, int, tuple[int, int | None]]
SPREAD = 16


def better(a: tuple[int, int | None], b: tuple[int, int | None]) -> bool:
    """More code points first, then the smaller id; an id that is null comes last."""
    return a[0] > b[0] or a[0] == b[0] and a[1] is not None and (b[1] is None or a[1] < b[1])


class OpenTable:
    """Open addressing with linear probing; equal means equal content, byte for byte."""

    def __init__(self) -> None:
        self.slots = np.full(1 << 10, -1, np.int64)
        self.hashes: list[int] = []
        self.entries: list[Entry] = []
        self.bytes = 0

    def _slot(self, content: bytes, h: int) -> int:
        last = len(self.slots) - 1
        at = h & last
        while (i := self.slots[at]) >= 0 and not (self.hashes[i] == h and self.entries[i][0] == content):
            at = at + 1 & last
        return at

    def add(self, entry: Entry, h: int) -> None:
        at = self._slot(entry[0], h)
        if (i := self.slots[at]) >= 0:
            content, n, own = self.entries[i]
            self.entries[i] = content, n + entry[1], entry[2] if better(entry[2], own) else own
            return
        self.slots[at] = len(self.entries)
        self.entries.append(entry)
        self.hashes.append(h)
        self.bytes += len(entry[0]) + 200
        if 2 * len(self.entries) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            for i, (e, h) in enumerate(zip(self.entries, self.hashes, strict=True)):
                self.slots[self._slot(e[0], h)] = i


def hash_of(content: bytes, level: int) -> int:
    """63 bits; each level of the recursion has a hash of its own."""
    return int.from_bytes(hashlib.blake2b(content, digest_size=8, salt=level.to_bytes(8, "little")).digest(), "little") >> 1


def grace(entries: Iterable[Entry], budget: int, level: int = 1, hashed: Callable[[bytes, int], int] = hash_of) -> Iterator[Entry]:
    """One entry for each content.  The table takes up to budget bytes of contents.

    Once it is full, contents that it holds still meet in it; others go to
    spill files by their hash, and each file is treated likewise with the next
    hash.  At most budget bytes plus one entry stay in memory; each level's
    table takes one content at least, so the recursion ends.
    """
    table = OpenTable()
    with tempfile.TemporaryDirectory() as folder:
        files: list[IO[bytes]] = []
        for e in entries:
            h = hashed(e[0], level)
            if not table.entries or table.bytes < budget or table.slots[table._slot(e[0], h)] >= 0:
                table.add(e, h)
            else:
                if not files:
                    files = [open(f"{folder}/{i}", "w+b") for i in range(SPREAD)]
                pickle.dump(e, files[h // 7 % SPREAD], pickle.HIGHEST_PROTOCOL)
        yield from table.entries
        del table
        for f in files:
            f.seek(0)
            yield from grace(_read(f), budget, level + 1, hashed)
            f.close()


def _read(f: IO[bytes]) -> Iterator[Entry]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _normalised(b: pa.RecordBatch) -> Iterator[tuple[int | None, int, bytes]]:
    """doc_id, code points of the text, the text without white space."""
    for i, t in zip(b["doc_id"].to_pylist(), texts(b["text"]), strict=True):
        yield i, len(t.decode("utf8", "replace")), t.translate(None, WHITE)


def exact_groups(docs: DataFrame, budget: int = 48 << 20, parts: int | None = None) -> DataFrame:
    """For each text, white space aside: text_sha256, keep_id, group_size.

    Map tasks first merge what they meet in tables of bounded size, so a text
    that a third of all rows share crosses the exchange about once a task.
    The exchange is the first partitioning; within each of its buckets,
    grace() recurses through spill files in the task's own temporary folder,
    deleted at its end.  A lost task is run again from its input.
    """
    parts = parts or fan_out(docs.sparkSession)
    merged = pa.schema([("bucket", pa.int32()), ("content", pa.binary()), ("n", pa.int64()), ("points", pa.int64()), ("id", pa.int64())])

    def packed(found: list[Entry], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(found), 500):
            some = found[at : at + 500]
            yield batch(schema, bucket=[hash_of(e[0], 0) % parts for e in some], content=[e[0] for e in some], n=[e[1] for e in some], points=[e[2][0] for e in some], id=[e[2][1] for e in some])

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = OpenTable()
        for b in pieces(batches, "text"):
            for i, points, content in _normalised(b):
                table.add((content, 1, (points, i)), hash_of(content, 1))
                if table.bytes > budget // 2:
                    yield from packed(table.entries, merged)
                    table = OpenTable()
        yield from packed(table.entries, merged)

    groups = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[Entry]:
            for b in batches:
                for r in zip(*(b[c].to_pylist() for c in ("content", "n", "points", "id")), strict=True):
                    yield r[0], r[1], (r[2], r[3])

        some: list[tuple] = []
        for content, n, (_, i) in grace(rows(), budget):
            some.append((hashlib.sha256(content).hexdigest(), i, n))
            if len(some) == 10_000:
                yield batch(groups, **dict(zip(groups.names, zip(*some, strict=True), strict=True)))
                some = []
        if some:
            yield batch(groups, **dict(zip(groups.names, zip(*some, strict=True), strict=True)))

    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(before, "bucket int, content binary, n long, points long, id long")
    return sent.repartition(parts, "bucket").mapInArrow(after, "text_sha256 string, keep_id long, group_size long")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, _points, text_sha256 of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("_points", pa.int64()), ("text_sha256", pa.string())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            rows = [(i, n, hashlib.sha256(t).hexdigest()) for i, n, t in _normalised(b)]
            yield batch(schema, doc_id=[r[0] for r in rows], _points=[r[1] for r in rows], text_sha256=[r[2] for r in rows])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, "doc_id long, _points long, text_sha256 string")


def exact_dedup(docs: DataFrame, budget: int = 48 << 20, parts: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs, dropped ones too.

    Texts are equal when identical without white space; a null text counts as
    empty, and all empty texts are one group.  Of each group the row with the
    most code points stays, then the smallest doc_id (null ids last).  Rows
    that repeat an id within a group are kept or dropped together.  Columns
    beyond doc_id and text play no part.  The rows meet their group by its
    SHA-256 in a join whose hot keys Spark may split, the groups' side holding
    one row each.
    """
    rows = digests(docs)
    out = rows.join(exact_groups(docs, budget, parts), "text_sha256", "left")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
