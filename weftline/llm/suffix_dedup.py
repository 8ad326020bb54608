"""Suffix-array dedup: repeated byte strings, found by a logarithmic family of suffix arrays.

Two suffixes that share `length` bytes share, at the same place, the smallest
gram of those bytes.  So the windows of `length` bytes of a document fall into
regions of neighbours with one smallest gram (its anchor), and equal windows
lie in regions with equal anchors.  Suffixes meet by their anchor's hash.

First, regions whose anchor is nowhere else go, as nothing in them repeats;
and equal regions, known by a 128-bit BLAKE2b digest of all their bytes, become
one that is known to repeat.  Then the suffixes of what is left are indexed:
each batch gets a suffix array in byte order, is scanned against the arrays
before it, and arrays of about equal size merge.  All its comparisons are of
bytes.

Passages that are repeated word by word go the same way, with words in place of
bytes: regions of windows of words, whose open ones are dealt window by window.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import WHITE, cut, fan_out, joined_windows, range_hashes, slices, texts, window_hashes

#: A longer text is scanned in segments of so many windows.
SEGMENT = 1 << 20
SLICE = 1 << 18
#: Suffixes that are sorted at once, and suffixes whose first bytes are laid out side by side to be compared.
SORTED = 1 << 16
BLOCK = 1 << 14
#: Words that anchor a window of more words.
WORD_GRAM = 12
#: Whether a byte belongs to a word.
IN_WORD = ~np.isin(np.arange(256), np.frombuffer(WHITE, np.uint8))
#: Bytes of text for each part of an exchange, where that gives more parts than Spark's setting.
PART_BYTES = 64 << 20
#: A region: hash of its anchor, digest, document, first and last window.  A range of window starts.  A window that is dealt by its own digest, and one of words.
ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("first", "<u4"), ("last", "<u4")])
RANGE = np.dtype([("doc", "<i8"), ("key", "<i8"), ("first", "<u4"), ("last", "<u4")])
SINGLE = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("at", "<u4"), ("asks", "u1")])
PASSAGE = np.dtype([*((f, SINGLE[f]) for f in SINGLE.names), ("end", "<u4")])


def digests(data: bytes, start: list[int], end: list[int]) -> np.ndarray:
    """128-bit digests of data[s:e], as rows of two words."""
    whole = b"".join([hashlib.blake2b(data[s:e], digest_size=16).digest() for s, e in zip(start, end, strict=True)])
    return np.frombuffer(whole, "<u8").reshape(-1, 2)


class SuffixArray:
    """Places in a text in the byte order of the `length` bytes from there, and which of those occur again."""

    def __init__(self, data: np.ndarray, at: np.ndarray, tag: np.ndarray, again: np.ndarray, length: int) -> None:
        self.data, self.at, self.tag, self.again, self.length = data, at, tag, again, length

    def __len__(self) -> int:
        return len(self.at)

    @classmethod
    def of(cls, data: np.ndarray, at: np.ndarray, tag: np.ndarray, length: int) -> SuffixArray:
        out = cls(data, at, tag, np.zeros(len(at), bool), length)
        keys = out.keys(0, len(at))
        order = np.argsort(keys, kind="stable")
        keys, out.at, out.tag = keys[order], at[order], tag[order]
        same = keys[1:] == keys[:-1]
        out.again[1:] |= same
        out.again[:-1] |= same
        return out

    def keys(self, i: int, j: int) -> np.ndarray:
        """The first `length` bytes of the suffixes from i to j, laid out; fixed-width strings compare as bytes."""
        view = np.lib.stride_tricks.sliding_window_view(self.data, self.length)
        return view[self.at[i:j]].view(f"S{self.length}").ravel()

    def place(self, key: np.ndarray, right: bool) -> int:
        """Number of suffixes below key, or with right up to key."""
        lo, hi = 0, len(self)
        while lo < hi:
            mid = (lo + hi) // 2
            own = self.keys(mid, mid + 1)[0]
            if own < key or right and own == key:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def places(self, other: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix of other how many of these are below it, and how many are up to it: both arrays are passed in order, in blocks."""
        left, right = np.zeros(len(other), np.int64), np.zeros(len(other), np.int64)
        for i in range(0, len(other), BLOCK):
            theirs = other.keys(i, min(i + BLOCK, len(other)))
            here = slice(i, i + len(theirs))
            lo, hi = self.place(theirs[0], False), self.place(theirs[-1], True)
            left[here] = right[here] = lo
            for j in range(lo, hi, BLOCK):
                own = self.keys(j, min(j + BLOCK, hi))
                a, z = int(np.searchsorted(theirs, own[0], "left")), int(np.searchsorted(theirs, own[-1], "right"))
                for to, side in ((left, "left"), (right, "right")):
                    to[i + a : i + z] += np.searchsorted(own, theirs[a:z], side)
                    to[i + z : i + len(theirs)] += len(own)
        return left, right


class SuffixLevels:
    """Suffix arrays of geometrically growing size.

    add() sorts the suffixes of a new batch, scans them against each level for
    long matches, marks both sides, and merges levels of about equal size: each
    suffix is merged a logarithmic number of times.
    """

    def __init__(self) -> None:
        self.levels: list[SuffixArray] = []

    def add(self, batch: SuffixArray) -> None:
        for level in self.levels:
            left, right = level.places(batch)
            hit = left < right
            batch.again |= hit
            change = np.zeros(len(level) + 1, np.int64)
            np.add.at(change, left[hit], 1)
            np.add.at(change, right[hit], -1)
            level.again |= np.cumsum(change[:-1]) > 0
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            self._merge()

    def finish(self) -> SuffixArray | None:
        """All suffixes in order, with their marks."""
        while len(self.levels) > 1:
            self._merge()
        return self.levels[0] if self.levels else None

    def _merge(self) -> None:
        y, x = self.levels.pop(), self.levels.pop()
        of_y = x.places(y)[1] + np.arange(len(y))
        of_x = np.ones(len(x) + len(y), bool)
        of_x[of_y] = False
        merged = SuffixArray(np.concatenate([x.data, y.data]), *(np.empty(len(of_x), k.dtype) for k in (x.at, x.tag, x.again)), x.length)
        for to, own, more in ((merged.at, x.at, y.at + len(x.data)), (merged.tag, x.tag, y.tag), (merged.again, x.again, y.again)):
            to[of_x], to[of_y] = own, more
        self.levels.append(merged)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i, by running minima of blocks from both ends."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def regions(pieces: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """piece, first and last window start (within the piece), anchor's hash and the region's digest, for each region."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    whole = b"".join(pieces)
    data = np.frombuffer(whole, np.uint8)
    counts = np.maximum(0, sizes - length + 1)
    if not counts.sum():
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64), np.empty((0, 2), np.uint64)
    starts = np.cumsum(sizes) - sizes
    grams = window_hashes(data, gram)
    low = np.uint64((1 << 24) - 1)  # places in a slice fit, as SEGMENT and SLICE are smaller
    smallest = sliding_minimum((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    of = np.repeat(np.arange(len(pieces)), counts)
    windows = np.arange(len(of)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    anchor = (smallest[windows] & low).astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(windows)) - 1
    p0, p1 = windows[first], windows[last]
    piece = of[first]
    return piece, p0 - starts[piece], p1 - starts[piece], grams[anchor[first]], digests(whole, p0.tolist(), (p1 + length).tolist())


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    edge = np.diff(IN_WORD[data].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_segments(text: bytes, words: int) -> Iterator[tuple[int, bytes]]:
    """Parts of a text, with their places, that hold each window of so many words once."""
    at, size = 0, SEGMENT
    while at + size < len(text):
        part = text[at : at + size]
        start, end = words_of(np.frombuffer(part, np.uint8))
        if len(start) <= 2 * words:
            size *= 2
            continue
        yield at, part[: end[-2]]  # the last word may go on
        at, size = at + int(start[len(start) - words]), SEGMENT
    yield at, text[at:]


def word_windows(pieces: list[bytes], words: int) -> tuple[np.ndarray, ...]:
    """Hash of each word; word, piece, start and end (within the piece) of each window of so many words."""
    sizes = np.array([len(p) + 1 for p in pieces], np.int64)
    data = np.frombuffer(b" ".join(pieces), np.uint8)
    start, end = words_of(data)
    before = np.cumsum(sizes) - sizes
    piece = np.searchsorted(before, start, "right") - 1
    n = max(0, len(start) - words + 1)
    at = np.flatnonzero(piece[:n] == piece[len(piece) - n :])
    piece = piece[at]
    return range_hashes(data, start, end), at, piece, start[at] - before[piece], end[at + words - 1] - before[piece]


def passage_regions(pieces: list[bytes], words: int, gram: int) -> tuple[np.ndarray, ...]:
    """As regions(), for windows of words: but the third column is the end of the last window, and gram counts words."""
    h, at, piece, start, end = word_windows(pieces, words)
    if not len(at):
        return piece, start, end, np.empty(0, np.uint64), np.empty((0, 2), np.uint64)
    grams = joined_windows(h, gram)
    low = np.uint64((1 << 24) - 1)
    smallest = sliding_minimum((grams & ~low) | np.arange(len(grams), dtype=np.uint64), words - gram + 1)
    anchor = (smallest[at] & low).astype(np.int64)
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])))
    last = np.append(first[1:], len(at)) - 1
    return piece[first], start[first], end[last], grams[anchor[first]], digests(h.tobytes(), (8 * at[first]).tolist(), (8 * (at[last] + words)).tolist())


def dealt(entries: np.ndarray, to: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Entries packed for each part."""
    order = np.argsort(to, kind="stable")
    parts, first = np.unique(to[order], return_index=True)
    for p, some in zip(parts.tolist(), np.split(entries[order], first[1:]), strict=True):
        yield p, some.tobytes()


def as_ranges(entries: np.ndarray) -> np.ndarray:
    out = np.empty(len(entries), RANGE)
    for f in RANGE.names:
        out[f] = entries[f]
    return out


def spans_of(rows: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, n: int) -> list[list[tuple[int, int]]]:
    """For each of n rows the maximal runs that windows starting in [first, last] cover."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if not len(rows):
        return out
    shift = rows.astype(np.int64) << 33
    start, end = shift + first.astype(np.int64), shift + last.astype(np.int64) + length
    order = np.argsort(start, kind="stable")
    start, end, rows = start[order], np.maximum.accumulate(end[order]), rows[order]
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    to = end[np.append(at[1:], len(start)) - 1]
    low = (1 << 33) - 1
    for r, a, b in zip(rows[at].tolist(), (start[at] & low).tolist(), (to & low).tolist(), strict=True):
        out[r].append((a, b))
    return out


def suffixes_of(bodies: list[bytes], first_tag: int, length: int) -> Iterator[SuffixArray]:
    """Sorted batches of the suffixes that start a window in these regions; tag: the body's number and the place in it."""
    for i, j in slices([len(x) - length + 1 for x in bodies], SORTED):
        data = np.frombuffer(b"".join(bodies[i:j]), np.uint8)
        ends = np.cumsum([len(x) for x in bodies[i:j]])
        counts = np.array([len(x) - length + 1 for x in bodies[i:j]], np.int64)
        row = np.repeat(np.arange(i, j), counts)
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = place + np.repeat(ends - counts - length + 1, counts)
        tag = ((row + first_tag).astype(np.int64) << 24) | place  # a region is shorter than its segment's windows
        for a in range(0, len(at), SORTED):
            yield SuffixArray.of(data, at[a : a + SORTED], tag[a : a + SORTED], length)


def repeated_spans(docs: DataFrame, length: int = 400, gram: int = 96, parts: int | None = None, crowd: int = 1000, words: int = 0) -> DataFrame:
    """doc_id, n_bytes, spans and kept of every row of docs; with words, passages too.

    spans: the maximal runs of bytes [start, end) of the UTF-8 text that are
    covered by a string of `length` bytes that also starts anywhere else, in
    this row or another; overlaps count.  kept: the other bytes, joined.  All
    is judged on the texts as given.  A null text is empty; texts shorter than
    `length` have no spans; very long ones are scanned in segments.  Rows that
    repeat an id and a text repeat each other.  An empty table gives an empty
    result.  Columns beyond doc_id and text play no part.

    passages: the runs of bytes [start, end) that are covered by `words`
    successive words that also start anywhere else, in this row or another, in
    whatever white space; overlapping ones are one.  They remove nothing.
    Words are known by 64-bit hashes, windows of them by 128-bit digests.

    Regions are dealt by anchor, packed in binary columns; what a map batch
    has met twice is settled there, so that a text with countless copies sends
    about one entry a batch.  Ranges go back to their document by two hashes of
    id and text.  An anchor with over `crowd` different regions does not bring
    their suffixes to one task: those are dealt one by one, by a 128-bit digest
    of their first `length` bytes, and equal digests count as equal.  Parts
    follow Spark's setting or the counted bytes of all texts, whichever gives
    more.  The regions' result is written to the shared folder.
    """
    spark = docs.sparkSession
    if not 0 < gram <= length:
        raise ValueError("gram must be between 1 and length")
    if words < 0:
        raise ValueError("words must not be negative")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.xxhash64(F.lit(1), "text")).alias("doc"), F.xxhash64("doc_id", "text").alias("key"), "text")
    parts = parts or max(fan_out(spark), math.ceil((docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) / PART_BYTES))
    cells = 4 * parts  # of documents: more than tasks, so that tasks get about equal numbers
    packed = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("blob", pa.binary())])
    SETTLED, OPEN, INDEX = 0, 1, 2  # ranges that are repeated; that must be looked at; that only stand for others
    CROWDED = 2  # more than OPEN and INDEX for those of crowded anchors
    WORDS = 5  # more than SETTLED, OPEN and INDEX for those of passages

    def out(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], packed.field(i).type) for i in range(3)], schema=packed)

    def in_order(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Regions by anchor and digest; whether each has the anchor, and the digest too, of the one before."""
        e = e[np.lexsort((e["c"], e["b"], e["a"]))]
        one = np.append(False, e["a"][1:] == e["a"][:-1])
        return e, one, one & np.append(False, (e["b"][1:] == e["b"][:-1]) & (e["c"][1:] == e["c"][:-1]))

    def first_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, key, text = b["doc"].to_numpy(), b["key"].to_numpy(), texts(b["text"])
            pieces = [(i, s, t[s : s + SEGMENT + length - 1]) for i, t in enumerate(text) for s in range(0, len(t) - length + 1, SEGMENT)]
            yield from merged(doc, key, pieces, lambda some: regions(some, length, gram), 0)
            if words:
                pieces = [(i, s, p) for i, t in enumerate(text) for s, p in word_segments(t, words)]
                yield from merged(doc, key, pieces, lambda some: passage_regions(some, words, min(words, WORD_GRAM)), WORDS)

    def merged(doc: np.ndarray, key: np.ndarray, pieces: list[tuple[int, int, bytes]], regions_of: Callable, more: int) -> Iterator[pa.RecordBatch]:
        found = []
        for i, j in slices([len(p[2]) for p in pieces], SLICE):
            some = pieces[i:j]
            piece, p0, p1, a, digest = regions_of([p[2] for p in some])
            row, offset = np.array([p[0] for p in some]), np.array([p[1] for p in some])
            e = np.zeros(len(piece), ENTRY)
            e["a"], e["b"], e["c"], e["doc"], e["key"] = a, digest[:, 0], digest[:, 1], doc[row[piece]], key[row[piece]]
            e["first"], e["last"] = p0 + offset[piece], p1 + offset[piece]
            found.append(e)
        if not found:
            return
        e, _, same = in_order(np.concatenate(found))
        many = same | np.append(same[1:], False)
        leads = ~same
        # The first of equal regions stands for all; sent twice, it is seen to repeat.
        sent = np.concatenate([e[leads], e[leads & many]])
        yield out([(p, OPEN + more, x) for p, x in dealt(sent, (sent["a"] % np.uint64(parts)).astype(np.int64))])
        if same.any():
            yield out([(p, SETTLED + more, x) for p, x in dealt(as_ranges(e[same]), e["key"][same] % cells)])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {0: [], WORDS: []}
        for b in batches:
            kinds, blobs = b["kind"].to_numpy(), b["blob"]
            settled = pa.RecordBatch.from_arrays([c.filter(pa.array(kinds % WORDS == SETTLED)) for c in b.columns], schema=packed)
            if settled.num_rows:
                yield settled
            for more, own in found.items():
                own += [np.frombuffer(blobs[int(i)].as_py(), ENTRY) for i in np.flatnonzero(kinds == OPEN + more)]
        for more in list(found):
            if own := found.pop(more):
                yield from compared(own, more)

    def compared(found: list[np.ndarray], more: int) -> Iterator[pa.RecordBatch]:
        e, one, two = in_order(np.concatenate(found))
        found.clear()
        if not len(e):
            return
        twice = two | np.append(two[1:], False)
        unsure = (one | np.append(one[1:], False)) & ~twice
        starts = np.flatnonzero(~one)
        sizes = np.diff(np.append(starts, len(e)))
        index_ = twice & ~two & np.repeat(np.logical_or.reduceat(unsure, starts), sizes)
        many = np.repeat(np.add.reduceat(unsure | index_, starts, dtype=np.int64) > crowd, sizes) & (more == 0)
        for kind, which in ((SETTLED, twice), (OPEN, unsure & ~many), (INDEX, index_ & ~many), (OPEN + CROWDED, unsure & many), (INDEX + CROWDED, index_ & many)):
            some = e[which]
            if len(some):
                yield out([(p, kind + more, x) for p, x in dealt(as_ranges(some) if kind == SETTLED else some, some["key"] % cells)])

    plain = "part int, kind tinyint, blob binary"
    scanned = rows.mapInArrow(first_scan, plain).repartitionById(parts, "part")
    round_one = cut(scanned.mapInArrow(index, plain))
    by_part = rows.withColumn("part", F.pmod("key", F.lit(cells)).cast("int"))
    suffixes = pa.schema([("part", pa.int32()), ("doc", pa.int64()), ("key", pa.int64()), ("first", pa.int64()), ("asks", pa.bool_()), ("body", pa.binary()), ("blob", pa.binary()), ("passages", pa.binary())])

    def bodies(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        """The text of regions that the second round needs."""
        wanted = [(np.frombuffer(x.as_py(), ENTRY), k.as_py()) for x, k in zip(theirs["blob"], theirs["kind"], strict=True)]
        if not wanted or not mine.num_rows:
            return suffixes.empty_table()
        where = {k: i for i, k in enumerate(zip(mine["doc"].to_pylist(), mine["key"].to_pylist(), strict=True))}
        text = mine["text"]
        got: list[tuple] = []
        singles: list[np.ndarray] = []
        passages: list[tuple] = []
        held: tuple[int, bytes] = (-1, b"")
        for e, kind in wanted:
            e = e[np.lexsort((e["first"], e["key"]))]
            for a, doc, key, first, last in zip(*(e[f].tolist() for f in ("a", "doc", "key", "first", "last")), strict=True):
                i = where[doc, key]
                if held[0] != i:
                    held = i, text[i].as_py().encode()
                if kind > WORDS:
                    passages.append((doc, key, first, kind == OPEN + WORDS, held[1][first:last]))
                elif kind > CROWDED:
                    one = np.zeros(last - first + 1, SINGLE)
                    at = range(first, last + 1)
                    digest = digests(held[1], at, range(first + length, last + length + 1))
                    one["a"], one["b"], one["doc"], one["key"], one["at"], one["asks"] = digest[:, 0], digest[:, 1], doc, key, at, kind == OPEN + CROWDED
                    singles.append(one)
                else:
                    got.append((a % parts, doc, key, first, kind == OPEN, held[1][first : last + length], None, None))
        if singles:
            x = np.concatenate(singles)
            got += [(p, None, None, None, None, None, blob, None) for p, blob in dealt(x, (x["a"] % np.uint64(parts)).astype(np.int64))]
        for i, j in slices([len(x[4]) for x in passages], SEGMENT):
            some = passages[i:j]
            h, at, piece, start, end = word_windows([x[4] for x in some], words)
            x = np.zeros(len(at), PASSAGE)
            digest = digests(h.tobytes(), (8 * at).tolist(), (8 * (at + words)).tolist())
            doc, key, first, asks = (np.array([y[k] for y in some], np.int64)[piece] for k in range(4))
            x["a"], x["b"], x["doc"], x["key"], x["at"], x["end"], x["asks"] = digest[:, 0], digest[:, 1], doc, key, first + start, first + end, asks
            got += [(p, None, None, None, None, None, None, blob) for p, blob in dealt(x, (x["a"] % np.uint64(parts)).astype(np.int64))]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), suffixes, strict=True)], schema=suffixes)

    opened = round_one.where(~F.col("kind").isin(SETTLED, SETTLED + WORDS))
    second = by_part.groupBy("part").cogroup(opened.groupBy("part")).applyInArrow(bodies, "part int, doc long, key long, first long, asks boolean, body binary, blob binary, passages binary")

    def runs(doc: np.ndarray, key: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        """Settled ranges of these windows."""
        order = np.lexsort((at, key, doc))
        doc, key, at = doc[order], key[order], at[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1))
        a = np.flatnonzero(new)
        found = np.empty(len(a), RANGE)
        found["doc"], found["key"], found["first"], found["last"] = doc[a], key[a], at[a], at[np.append(a[1:], len(at)) - 1]
        return out([(p, SETTLED, x) for p, x in dealt(found, found["key"] % cells)])

    def again(s: np.ndarray) -> np.ndarray:
        """Windows that ask and whose digest another has too."""
        s = s[np.lexsort((s["b"], s["a"]))]
        same = (s["a"][1:] == s["a"][:-1]) & (s["b"][1:] == s["b"][:-1])
        return s[(np.append(False, same) | np.append(same, False)) & (s["asks"] > 0)]

    def passage_runs(s: np.ndarray) -> pa.RecordBatch:
        """Settled ranges of these windows of words."""
        s = s[np.lexsort((s["at"], s["key"], s["doc"]))]
        a = np.flatnonzero(np.append(True, (s["doc"][1:] != s["doc"][:-1]) | (s["key"][1:] != s["key"][:-1]) | (s["at"][1:] > s["end"][:-1])))
        found = np.empty(len(a), RANGE)
        found["doc"], found["key"], found["first"], found["last"] = s["doc"][a], s["key"][a], s["at"][a], s["end"][np.append(a[1:], len(s)) - 1]
        return out([(p, SETTLED + WORDS, x) for p, x in dealt(found, found["key"] % cells)])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, singles, passages = SuffixLevels(), [], []
        whose: list[np.ndarray] = []
        n = 0
        for b in batches:
            singles += [np.frombuffer(x.as_py(), SINGLE) for x in b["blob"].drop_null()]
            passages += [np.frombuffer(x.as_py(), PASSAGE) for x in b["passages"].drop_null()]
            regional = b.filter(b["body"].is_valid())
            if regional.num_rows:
                whose.append(np.stack([regional[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc", "key", "first", "asks")]))
                for batch in suffixes_of([x.as_py() for x in regional["body"]], n, length):
                    levels.add(batch)
                n += regional.num_rows
        if singles:
            s = again(np.concatenate(singles))
            if len(s):
                yield runs(s["doc"], s["key"], s["at"].astype(np.int64))
        if passages:
            s = again(np.concatenate(passages))
            if len(s):
                yield passage_runs(s)
        array = levels.finish()
        if array is not None:
            doc, key, first, asks = np.concatenate(whose, axis=1)
            row, place = array.tag >> 24, array.tag & ((1 << 24) - 1)
            hit = array.again & (asks[row] > 0)
            row, place = row[hit], place[hit]
            if len(row):
                yield runs(doc[row], key[row], first[row] + place)

    round_two = second.repartitionById(parts, "part").mapInArrow(search, plain)
    ranges = round_one.where(F.col("kind").isin(SETTLED, SETTLED + WORDS)).unionByName(round_two)
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", runs_type), ("kept", pa.binary()), ("passages", runs_type)])

    def settle(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        pairs = list(zip(mine["doc"].to_pylist(), mine["key"].to_pylist(), strict=True))
        where: dict[tuple[int, int], int] = {}
        for p in pairs:
            where.setdefault(p, len(where))
        both = []
        for more, span in ((0, length), (WORDS, 0)):
            own = theirs["blob"].filter(pc.equal(theirs["kind"], SETTLED + more))
            r = np.concatenate([np.empty(0, RANGE), *(np.frombuffer(x.as_py(), RANGE) for x in own)])
            at = np.fromiter((where[p] for p in zip(r["doc"].tolist(), r["key"].tolist(), strict=True)), np.int64, len(r))
            both.append(spans_of(at, r["first"], r["last"], span, len(where)))
        spans, passages = both
        as_structs = lambda own: [{"start": a, "end": b} for a, b in own]
        ids, sizes, found, kept = mine["doc_id"].combine_chunks(), [], [], []
        for p, t in zip(pairs, mine["text"], strict=True):
            own, t = spans[where[p]], (t.as_py() or "").encode()
            edges = [0, *(x for s in own for x in s), len(t)]
            sizes.append(len(t))
            found.append(as_structs(own))
            kept.append(b"".join(t[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)) if own else t)
        return pa.Table.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(found, runs_type), pa.array(kept, pa.binary()), pa.array([as_structs(passages[where[p]]) for p in pairs], runs_type)], schema=result)

    settled = by_part.groupBy("part").cogroup(ranges.groupBy("part")).applyInArrow(settle, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, passages array<struct<start:long,end:long>>")
    return settled if words else settled.drop("passages")


def removal_digest() -> list[str | Column]:
    """Columns n_bytes, n_removed, n_spans and kept_sha256 from those of repeated_spans."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return ["n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]
