"""N-gram Jaccard join by PartEnum signatures, and its connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import WHITE, batch, cut, fan_out, joined, mix64, pieces, range_hashes, slices, texts
from weftline.llm.components import components

U = np.uint64
WORDS = 5
SLICE = 1 << 20
#: Partitionings of the domain that are tried before empty projections count.
SEEDS = 6
#: A side of the join that fetches texts is broadcast up to this many rows.
BROADCAST_ROWS = 200_000
_SPACE = np.zeros(256, bool)
_SPACE[list(WHITE)] = True
_STEP = U(0xC2B2AE3D27D4EB4F)


def shingles(docs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """For each document its shingles' hashes, and their first and last byte in the text that comes last."""
    for i, j in slices([len(d) for d in docs], SLICE):
        some = [d.lower() for d in docs[i:j]]
        whole = b" ".join(some) + b" "
        data = np.frombuffer(whole, np.uint8)
        solid = ~_SPACE[data]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]])))
        start, end = edges[::2], edges[1::2]
        words = range_hashes(data, start, end)
        limits = np.searchsorted(start, np.cumsum([0] + [len(d) + 1 for d in some]))
        rolled = np.full(max(0, len(words) - WORDS + 1), WORDS, U)
        for t in range(WORDS):
            rolled = joined(rolled, words[t : t + len(rolled)])
        for a, b in zip(limits[:-1], limits[1:], strict=True):
            if b - a >= WORDS:
                yield rolled[a : b - WORDS + 1], start[a : b - WORDS + 1], end[a + WORDS - 1 : b], whole
            else:
                h = np.full(min(1, b - a), b - a, U)
                for w in range(a, b):
                    h = joined(h, words[w : w + 1])
                yield h, start[a : a + len(h)], end[b - len(h) : b], whole


def shingle_sets(docs: list[bytes]) -> list[np.ndarray]:
    """The set of each document, as sorted hashes of its shingles."""
    return [np.unique(s[0]) for s in shingles(docs)]


def bands(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper ends of each size's band and of the next band: [l, 5l/4] from 1 on."""
    ends, low = [0], 1
    top = 2 * int(sizes.max(initial=1)) + 2
    while ends[-1] < top:
        ends.append(low * 5 // 4)
        low = ends[-1] + 1
    ends = np.array(ends)
    at = np.searchsorted(ends, sizes)
    return ends[at], ends[at + 1]


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures: (set's position, signature), such that linked sets of different content share one.

    A pair is looked for under the band of its larger set, so a set signs for
    its own band and, if it can be the smaller side, for the next.  Sets of a
    band differ in at most k = 2/9 of its upper end.  The domain is hashed into
    n1 partitions of 3 cells.  At least n1 - k/2 partitions hold one
    difference at most, and then two of their cells agree: every pair of cells
    makes a signature of what the set has there.

    Projections without features would be shared by strangers.  As long as a
    set has fewer partitions with such projections than the pair must have
    good ones, it can leave them out.  Sets that have more sign again under the
    next seed, where all such sets meet; after the last they are signed too.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    whole = np.concatenate([np.empty(0, U), *sets])
    begin = np.cumsum(sizes) - sizes
    own, following = bands(sizes)
    small = (sizes * 5 // 4 > own) & (sizes > 0)
    who = np.concatenate([np.flatnonzero(sizes > 0), np.flatnonzero(small)])
    upper = np.concatenate([own[sizes > 0], following[small]])
    keep = 2 * upper // 9 > 0
    who, upper = who[keep], upper[keep]
    rows, signed = [], []
    for seed in range(SEEDS):
        if not len(who):
            break
        k = 2 * upper // 9
        n1 = np.maximum((k + 2) // 2, k // 2 * 6 // 5 + 1)
        n = sizes[who]
        job = np.repeat(np.arange(len(who)), n)
        f = whole[np.arange(len(job)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[who], n)]
        h = mix64(f + U((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        first = np.cumsum(n1) - n1
        cell = (first[job] + ((h >> U(32)) * n1[job].astype(U) >> U(32)).astype(np.int64)) * 3 + ((h & U(0xFFFFFFFF)) * U(3) >> U(32)).astype(np.int64)
        count = np.bincount(cell, minlength=3 * int(n1.sum())).reshape(-1, 3)
        content = np.zeros(count.size, U)
        np.add.at(content, cell, mix64(h ^ _STEP))
        content = content.reshape(-1, 3)
        others, content = count.sum(axis=1, keepdims=True) - count, content.sum(axis=1, keepdims=True, dtype=U) - content
        part = np.repeat(np.arange(len(who)), n1)
        place = (np.arange(len(part)) - first[part])[:, None] * 3 + np.arange(3)
        salt = mix64((upper[part].astype(U)[:, None] << U(32)) + place.astype(U) * U(SEEDS) + U(seed))
        value = mix64(content * _STEP + salt)
        weak = np.add.reduceat((others == 0).any(axis=1), first) >= n1 - k // 2
        use = (others > 0) | (weak[part, None] if seed == SEEDS - 1 else False)
        rows.append(np.broadcast_to(who[part][:, None], use.shape)[use])
        signed.append(value[use])
        who, upper = who[weak], upper[weak]
    return np.concatenate([np.empty(0, np.int64), *rows]), np.concatenate([np.empty(0, U), *signed])


def sketch(items: np.ndarray) -> bytes:
    """Parities of the items that fall on each bit: sketches differ in no more bits than the sets in items."""
    bits = max(64, 1 << int(2 * len(items) - 1).bit_length()) if len(items) else 64
    return np.packbits((np.bincount((items & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Rows of 64-bit words; wider sketches are folded, which keeps the bound."""
    width = min(map(len, sketches))
    out = np.empty((len(sketches), width), np.uint8)
    for i, s in enumerate(sketches):
        x = np.frombuffer(s, np.uint8)
        out[i] = np.bitwise_xor.reduce(x.reshape(-1, width), axis=0)
    return out.view(U)


def possible(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m with these sketches may differ in few enough items: 9 * difference <= n + m."""
    return 9 * np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= n + m


def pack(cids: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted by id: ids, their counts, and 40 bits of each value.  Fewer bits only make strangers meet, whom the check parts."""
    order = np.argsort(cids, kind="stable")
    ids, counts = np.unique(cids, return_counts=True)
    low = np.ascontiguousarray(values[order]).view(np.uint8).reshape(-1, 8)[:, :5]
    return np.int64(len(ids)).tobytes() + ids.astype(np.int64).tobytes() + counts.astype(np.int32).tobytes() + low.tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    ids = np.frombuffer(blob, np.int64, n, 8)
    counts = np.frombuffer(blob, np.int32, n, 8 + 8 * n)
    low = np.frombuffer(blob, np.uint8, offset=8 + 12 * n).reshape(-1, 5)
    values = np.zeros((len(low), 8), np.uint8)
    values[:, :5] = low
    return np.repeat(ids, counts), values.view(U).ravel()


_ROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("second", pa.int64()), ("sketch", pa.binary()), ("digest", pa.int64())])
_SENT = pa.schema([("part", pa.int32()), ("blob", pa.binary())])
_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("gid", pa.int64())])


#: Bits of a class id; fewer of them make different sets share one.
ID_BITS = U((1 << 64) - 1)


def class_ids(sets: list[np.ndarray], clashes: tuple[int, ...] = ()) -> np.ndarray:
    """Two hashes of each whole set: rows of (id, second hash).  A set whose id is among the clashes has one from both hashes instead."""
    out = np.zeros((len(sets), 2), np.int64)
    for i, s in enumerate(sets):
        sums = [mix64(s ^ k).sum(dtype=U) + U(len(s)) for k in (_STEP, mix64(np.array([_STEP]))[0])]
        one, two = mix64(np.array(sums, U))
        one &= ID_BITS
        if clashes and int(one.view(np.int64)) in clashes:
            one = joined(np.array([one]), np.array([two]))[0]
        out[i] = one.view(np.int64), two.view(np.int64)
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("digest", text_digest())


def text_digest() -> Column:
    """With doc_id it tells rows apart even where ids repeat or are null."""
    return F.xxhash64(F.col("text").cast("string"))


def set_rows(docs: DataFrame, clashes: tuple[int, ...] = ()) -> DataFrame:
    """doc_id, n, cid and second (hashes of the set), sketch and digest of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            sets = shingle_sets(texts(b["text"]))
            ids = class_ids(sets, clashes)
            yield batch(_ROW, doc_id=b["doc_id"], n=[len(s) for s in sets], cid=ids[:, 0], second=ids[:, 1], sketch=[sketch(s) for s in sets], digest=b["digest"])

    return _texts(docs).mapInArrow(run, "doc_id long, n long, cid long, second long, sketch binary, digest long")


def shared_signatures(docs: DataFrame, parts: int, clashes: tuple[int, ...] = ()) -> DataFrame:
    """Pairs (a, b) of the smallest class of each signature and another one; and members (gid, a) of groups of 3 classes and more that share one.

    Signatures travel packed, one binary row for each map batch and part.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            sets = shingle_sets(texts(b["text"]))
            cids = class_ids(sets, clashes)[:, 0]
            _, once = np.unique(cids, return_index=True)  # copies sign once a piece
            sets, cids = [sets[i] for i in once], cids[once]
            for i, j in slices([8 * len(s) for s in sets], 8 << 19):
                row, value = signatures(sets[i:j])
                to = (value >> U(40)) % U(parts)
                order = np.argsort(to, kind="stable")
                there, first = np.unique(to[order], return_index=True)
                yield batch(_SENT, part=there.astype(np.int32), blob=[pack(cids[i:j][row[o]], value[o]) for o in np.split(order, first[1:])] if len(there) else [])

    def rows(**columns) -> Iterator[pa.RecordBatch]:
        n = next(len(c) for c in columns.values())
        for i in range(0, n, 1 << 16):
            m = min(n, i + (1 << 16)) - i
            yield batch(_MET, **{f.name: columns[f.name][i : i + m] if f.name in columns else [None] * m for f in _MET})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [unpack(x.as_py()) for b in batches for x in b["blob"]]
        if not got:
            return
        cid, value = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        del got
        order = np.argsort(value, kind="stable")
        v = value[order]
        again = np.zeros(len(v), bool)  # signatures that occur more than once
        again[1:] |= v[1:] == v[:-1]
        again[:-1] |= v[1:] == v[:-1]
        order = order[again]
        cid, value = cid[order], value[order]
        order = np.lexsort((cid, value))
        cid, value = cid[order], value[order]
        new = np.append(True, (value[1:] != value[:-1]) | (cid[1:] != cid[:-1])) if len(cid) else np.empty(0, bool)
        cid, value = cid[new], value[new]
        starts = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(cid) else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, len(cid)))
        hub, rest = np.repeat(cid[starts], sizes), np.ones(len(cid), bool)
        rest[starts] = False
        pairs = np.unique(np.stack([hub[rest], cid[rest]], axis=1), axis=0) if rest.any() else np.empty((0, 2), np.int64)
        if len(pairs):
            yield from rows(a=pairs[:, 0], b=pairs[:, 1])
        listed: dict[int, slice] = {}  # a group is known by its members, as many signatures share the same
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            listed.setdefault(int.from_bytes(hashlib.blake2b(cid[s : s + n].tobytes(), digest_size=8).digest(), "little", signed=True), slice(s, s + n))
        for some in range(0, len(listed), 1024):
            groups = list(listed.items())[some : some + 1024]
            yield from rows(a=np.concatenate([cid[where] for _, where in groups]), gid=np.concatenate([np.full(where.stop - where.start, g) for g, where in groups]))

    return _texts(docs).select("text").mapInArrow(sign, "part int, blob binary").repartitionById(parts, "part").mapInArrow(meet, "a long, b long, gid long")


def may_link(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches allow a link."""
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b["na"].to_numpy(), b["nb"].to_numpy()
            x, y = b["sa"].to_pylist(), b["sb"].to_pylist()
            ok = np.zeros(len(n), bool)
            widths = np.array([min(len(p), len(q)) for p, q in zip(x, y, strict=True)])
            for w in np.unique(widths):
                at = np.flatnonzero(widths == w)
                both = folded([*(x[i] for i in at), *(y[i] for i in at), bytes(int(w))])
                ok[at] = possible(both[: len(at)], n[at], both[len(at) : -1], m[at])
            yield batch(schema, a=b["a"].to_numpy()[ok], b=b["b"].to_numpy()[ok])

    near = (F.col("na") * 5 >= F.col("nb") * 4) & (F.col("nb") * 5 >= F.col("na") * 4)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(near).mapInArrow(run, "a long, b long")


def common(x: bytes, y: bytes) -> tuple[int, int]:
    """Sizes of the intersection and the union of two texts' sets.  Shingles with equal hashes count as common if their words are equal."""
    (one, a0, a1, s), (two, b0, b1, t) = (next(shingles([d])) for d in (x, y))
    one, at = np.unique(one, return_index=True)
    two, to = np.unique(two, return_index=True)
    _, i, j = np.intersect1d(one, two, assume_unique=True, return_indices=True)
    i, j = at[i], to[j]
    same = sum(s[a:b] == t[c:d] for a, b, c, d in zip(a0[i].tolist(), a1[i].tolist(), b0[j].tolist(), b1[j].tolist(), strict=True))
    return same, len(one) + len(two) - same


def linked(pairs: DataFrame, docs: DataFrame, leads: DataFrame, clashes: tuple[int, ...] = (), numerator: int = 80) -> DataFrame:
    """The pairs of classes (a, b) with 100 * intersection >= numerator * union, by the words of their whole sets.

    leads: cid and key (doc_id, or the text's digest where all ids are null)
    of a row of each class, whose text gives the set.
    """
    needed = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    schema = pa.schema([("cid", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            read = texts(b["text"])
            ids, own = class_ids(shingle_sets(read), clashes)[:, 0], b["cid"].to_numpy()
            right = [k for k in range(len(own)) if ids[k] == own[k]]  # another row may repeat the id
            for i, j in slices([len(read[k]) for k in right], 1 << 22):
                yield batch(schema, cid=own[right[i:j]], words=[b" ".join(read[k].lower().split()) for k in right[i:j]])

    chosen = cut(leads.join(needed, "cid", "left_semi"))
    if chosen.count() <= BROADCAST_ROWS:  # of two numbers each; else Spark's own joins
        chosen = F.broadcast(chosen)
    read = cut(_texts(docs).withColumn("key", F.coalesce("doc_id", "digest")).join(chosen, "key").select("cid", "text").mapInArrow(run, "cid long, words binary").dropDuplicates(["cid"]))
    side = lambda c: read.select(F.col("cid").alias(c), F.col("words").alias(f"w{c}"))
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                both, whole = common(b["wa"][i].as_py(), b["wb"][i].as_py())
                ok[i] = 100 * both >= numerator * whole
            yield batch(pair, a=b["a"].to_numpy()[ok], b=b["b"].to_numpy()[ok])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(check, "a long, b long")


def close_pairs(gid: np.ndarray, label: np.ndarray, n: np.ndarray, side: np.ndarray, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions (x, y) and distances of pairs within runs of one gid that may link and whose labels differ.

    Rows are in order of gid, then n.  side: 0 or 1 for the blocks of a pair
    of blocks, whose own pairs are looked at elsewhere; -1 where there is one.
    """
    ends = np.searchsorted(gid, gid, "right")
    count = ends - np.arange(len(gid)) - 1
    width = np.array([len(w) for w in words])

    def matrix(w: int, which: np.ndarray) -> np.ndarray:
        """Sketches of these rows, folded to width w."""
        at, back = np.unique(which, return_inverse=True)
        return folded([*(words[i] for i in at), bytes(w)])[back]

    for i, j in slices(count.tolist(), 1 << 18):
        x = np.repeat(np.arange(i, j), count[i:j])
        y = np.arange(len(x)) - np.repeat(np.cumsum(count[i:j]) - count[i:j], count[i:j]) + x + 1
        ok = (label[x] != label[y]) & (4 * n[y] <= 5 * n[x]) & ((side[x] < 0) | (side[x] != side[y]))
        x, y = x[ok], y[ok]
        both = np.minimum(width[x], width[y])
        for w in np.unique(both):
            here = np.flatnonzero(both == w)
            for k in range(0, len(here), max(1, (1 << 22) // int(w))):
                p, q = x[here[k : k + (1 << 22) // int(w)]], y[here[k : k + (1 << 22) // int(w)]]
                far = np.bitwise_count(matrix(int(w), p) ^ matrix(int(w), q)).sum(axis=1, dtype=np.int64)
                fits = 9 * far <= n[p] + n[q]
                yield p[fits], q[fits], far[fits]


def missing_pairs(groups: DataFrame, labels: DataFrame, classes: DataFrame, first: bool, few: int = 16, block: int = 1024) -> DataFrame:
    """Pairs within groups (gid, cid) that may link and whose labels differ.

    Groups of one label are done.  Others are compared by sketches, and no
    pair leaves a task that those exclude.  Groups over `block` are cut into
    blocks, and each pair of blocks is compared apart.  first: of groups over
    `few` only the likeliest pair for each two labels, which mostly joins
    them; without first, such groups alone, and all their pairs.  A pair may
    come more than once.
    """
    marked = groups.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    mixed = marked.groupBy("gid").agg(F.count("*").alias("m"), F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h")
    mixed = (mixed if first else mixed.where(F.col("m") > few)).select("gid", (F.col("m") > few).alias("many"), F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    here = marked.join(mixed, "gid").join(classes, "cid")
    here = here.withColumn("own", F.pmod(F.xxhash64("cid"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    here = here.select(F.when(F.col("blocks") == 1, F.col("gid")).otherwise(F.xxhash64("gid", i, j)).alias("cell"), F.when(i == j, -1).otherwise((F.col("own") == j).cast("int")).alias("side"), "many", "cid", "label", "n", "sketch")
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    most = 500_000  # pairs that a task remembers
    limit = 2 * block  # rows that are compared at once, or one whole cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        seen: set[tuple[int, int]] = set()
        for b in batches:
            held.append(b)
            t = pa.Table.from_batches(held).combine_chunks()
            cell = t["cell"].to_numpy()
            whole = int(np.searchsorted(cell, cell[-1], "left"))  # the last cell may go on
            if whole >= limit:
                yield compare(t.slice(0, whole), seen)
                held = t.slice(whole).combine_chunks().to_batches()
        if held:
            yield compare(pa.Table.from_batches(held).combine_chunks(), seen)

    def compare(t: pa.Table, seen: set[tuple[int, int]]) -> pa.RecordBatch:
        cid, label, many = t["cid"].to_numpy(), t["label"].to_numpy(), t["many"].to_numpy()
        found = [np.stack(f) for f in close_pairs(t["cell"].to_numpy(), label, t["n"].to_numpy(), t["side"].to_numpy(), t["sketch"].to_pylist())]
        x, y, far = np.concatenate([np.empty((3, 0), np.int64), *found], axis=1)
        keep = ~many[x] if first else np.ones(len(x), bool)
        if first and not keep.all():
            one, other = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
            order = np.lexsort((far, other, one, keep))
            lead = np.ones(len(order), bool)
            lead[1:] = (one[order][1:] != one[order][:-1]) | (other[order][1:] != other[order][:-1])
            keep[order[lead]] = True
        p, q = cid[x[keep]], cid[y[keep]]
        pairs = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1), axis=0)
        new = np.array([x not in seen for x in map(tuple, pairs.tolist())], bool)  # other signatures of this task give them again
        seen.update(map(tuple, pairs[new].tolist()))
        if len(seen) > most:
            seen.clear()
        return batch(pair, a=pairs[new, 0], b=pairs[new, 1])

    return here.repartition("cell").sortWithinPartitions("cell", "n", "cid").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, parts: int | None = None, few: int = 16, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs.

    Words are runs without white space, A-Z in lower case.  A row's set holds
    its distinct shingles of five words; with fewer words, the whole sequence
    as one; without words, or with a null text, nothing, and then it is linked
    with nothing.  Rows link when 100 * intersection >= 80 * union.
    component_id is the smallest doc_id that links reach; for a row with an
    empty set its own.  Rows with a null id take part and come last in order.
    Whole texts count, however long; an empty table gives an empty result.
    Rows with equal sets are one class, so copies are never paired; a class is
    known by two 64-bit hashes of its set.  Other columns play no part.

    Classes that share a PartEnum signature are first compared with the
    smallest of them, sketches before whole sets, by their words; links make
    components.  Then every signature whose classes are not all in one
    component is searched for pairs between components: first the likeliest of
    large signatures and all of others, then all that may link in large ones,
    so that no link is lost.
    """
    rows, heads = labelled(docs, parts, few, block)
    out = rows.join(heads.select("cid", "least"), "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def labelled(docs: DataFrame, parts: int | None = None, few: int = 16, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, cid, digest) of docs; and of each class that is not empty (cid) the first row of its component: none (whether its id is null), least (its id) and digest.

    Components are reduced to their first row at the level of classes, so no
    row travels by its component; a class has one line to join its rows with.
    """
    parts = parts or fan_out(docs.sparkSession)
    clashes: tuple[int, ...] = ()
    while True:
        rows = cut(set_rows(docs, clashes))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("least"), "digest")).alias("first")
        classes = cut(rows.where("n > 0").groupBy("cid").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"), first, (F.min("second") != F.max("second")).alias("clash")))
        more = [r["cid"] for r in classes.where("clash").select("cid").collect()]  # ids that different sets happen to share, a handful in 10^10 sets
        if not more:
            break
        clashes += tuple(more)
    leads = classes.select("cid", F.coalesce("first.least", "first.digest").alias("key"))
    sketches = classes.select("cid", "n", "sketch")
    met = cut(shared_signatures(docs, parts, clashes))
    stars = met.where("gid is null").select("a", "b").distinct()
    links = cut(linked(cut(may_link(stars, sketches)), docs, leads, clashes))
    labels = components(links)
    groups = cut(met.where("gid is not null").select("gid", F.col("a").alias("cid")).distinct())
    tested = stars
    for once in (True, False):
        more_pairs = cut(missing_pairs(groups, labels, sketches, once, few, block).distinct().join(tested, ["a", "b"], "left_anti"))
        if not more_pairs.isEmpty():
            tested = tested.unionByName(more_pairs)
            links = cut(links.unionByName(linked(more_pairs, docs, leads, clashes)))
            labels = components(links)
    named = cut(labels.withColumnRenamed("node", "cid").join(classes.select("cid", "first"), "cid"))
    least = named.groupBy("label").agg(F.min("first").alias("least"))
    joined_ = cut(named.select("cid", "label").join(least, "label").select("cid", "least"))
    heads = classes.select("cid", "first").join(joined_, "cid", "left").select("cid", F.coalesce("least", "first").alias("x")).select("cid", "x.none", "x.least", "x.digest")
    return rows.select("doc_id", "n", "cid", "digest"), cut(heads)


def survivors(docs: DataFrame) -> DataFrame:
    """doc_id and digest of the rows that stay: of each component the first by id, nulls last, then by digest; all whose set is empty."""
    rows, heads = labelled(docs)
    kept = heads.select(F.col("least").alias("doc_id"), "digest").distinct()
    return kept.unionByName(rows.where("n = 0").select("doc_id", "digest"))
