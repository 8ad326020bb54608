"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of whole documents."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fresh, pieces, quoted, sample_by_id, slices, texts, without

WIDTH, FILTERS, DIMS, CHUNK = 6, 16, 8, 512
SLICE = 1 << 18


@dataclass
class Layout:
    """Documents end to end, each filled up with zero bytes to WIDTH at least.

    Filter positions of a document are cut into chunks of CHUNK; a chunk reads
    WIDTH - 1 bytes of the next one.  Positions that would reach into another
    document are a segment that is left out.
    """

    data: np.ndarray
    segments: np.ndarray  # first position of each segment
    inside: np.ndarray  # whether a segment is a chunk
    doc: np.ndarray  # of each chunk
    n: int

    @classmethod
    def of(cls, docs: list[bytes]) -> Layout:
        docs = [d.ljust(WIDTH, b"\0") for d in docs]
        segments, inside, doc, at = [], [], [], 0
        for i, d in enumerate(docs):
            first = np.arange(at, at + len(d) - WIDTH + 1, CHUNK)
            segments += [first, [at + len(d) - WIDTH + 1]]
            inside += [np.ones(len(first), bool), [False]]
            doc.append(np.full(len(first), i))
            at += len(d)
        data = np.frombuffer(b"".join(docs) + b"\0" * WIDTH, np.uint8)
        return cls(data, np.concatenate(segments).astype(np.int64), np.concatenate(inside).astype(bool), np.concatenate(doc), len(docs))


@dataclass
class ByteNet:
    bytes: np.ndarray  # 256 x DIMS
    filters: np.ndarray  # WIDTH x DIMS x FILTERS
    bias: np.ndarray
    top: np.ndarray  # mean and maximum over chunks -> one logit
    offset: np.ndarray

    @classmethod
    def fresh(cls, seed: int) -> ByteNet:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.5, (256, DIMS)), r.normal(0, 0.3, (WIDTH, DIMS, FILTERS)), np.zeros(FILTERS), r.normal(0, 0.1, 2 * FILTERS), np.zeros(1))

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Every filter at every position: each byte adds its row of a table per place in the filter."""
        n = len(data) - WIDTH
        out = np.zeros((n, FILTERS), np.float32)
        for j in range(WIDTH):
            out += (self.bytes @ self.filters[j]).astype(np.float32)[data[j : j + n]]
        return out

    def features(self, peaks: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean and maximum over a document's chunks of the rectified peaks; and each document's first chunk."""
        hot = np.maximum(0, peaks + self.bias)
        first = np.searchsorted(doc, np.arange(n))
        chunks = np.diff(np.append(first, len(doc)))
        return np.concatenate([np.add.reduceat(hot, first) / chunks[:, None], np.maximum.reduceat(hot, first)], axis=1), first

    def scores(self, docs: list[bytes]) -> np.ndarray:
        """Probabilities of label 1, of whole documents."""
        out = []
        for i, j in slices([len(d) for d in docs], SLICE):
            x = Layout.of(docs[i:j])
            peaks = self.peaks(x)
            f, _ = self.features(peaks, x.doc, x.n)
            out.append(1 / (1 + np.exp(-np.clip(f @ self.top + self.offset[0], -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)

    def peaks(self, x: Layout) -> np.ndarray:
        """Maximum of each filter over each chunk, in blocks of chunks so that a long document takes no more memory."""
        parts, edges = [], np.append(x.segments, len(x.data) - WIDTH)
        for a in range(0, len(x.segments), 1024):
            b = min(a + 1024, len(x.segments))
            if edges[b] > edges[a]:
                r = self.responses(x.data[edges[a] : edges[b] + WIDTH])
                parts.append(np.maximum.reduceat(r, np.minimum(x.segments[a:b] - edges[a], len(r) - 1)))
            else:
                parts.append(np.zeros((b - a, FILTERS), np.float32))
        return np.concatenate(parts)[x.inside]

    def train_step(self, x: Layout, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weighted logistic loss; only each chunk's peak positions pass any back."""
        r = self.responses(x.data)
        edges = np.append(x.segments, len(r))
        spans = [(edges[k], edges[k + 1]) for k in np.flatnonzero(x.inside)]
        at = np.stack([a + r[a:b].argmax(axis=0) for a, b in spans])  # chunks x FILTERS
        peaks = r[at, np.arange(FILTERS)]
        f, first = self.features(peaks, x.doc, x.n)
        p = 1 / (1 + np.exp(-np.clip(f @ self.top + self.offset[0], -30, 30)))
        err = (p - label) * weight / x.n
        hot = np.maximum(0, peaks + self.bias)
        back = err[:, None] * self.top
        chunks = np.bincount(x.doc, minlength=x.n)
        g = back[x.doc, :FILTERS] / chunks[x.doc, None]
        highest = f[x.doc, FILTERS:]
        ties = np.cumsum(hot == highest, axis=0)
        before = np.concatenate([np.zeros((1, FILTERS), int), ties])[first]
        g = g + back[x.doc, FILTERS:] * ((hot == highest) & (ties - before[x.doc] == 1))  # the first of equal chunks
        g = g * (peaks + self.bias > 0)
        d_bytes, d_filters = np.zeros_like(self.bytes), np.zeros_like(self.filters)
        for j in range(WIDTH):
            read = x.data[at + j]  # chunks x FILTERS
            own = np.zeros((256, FILTERS))
            np.add.at(own, (read, np.arange(FILTERS)), g)
            d_filters[j] = self.bytes.T @ own
            d_bytes += own @ self.filters[j].T
        return [d_bytes, d_filters, g.sum(axis=0), f.T @ err, np.array([err.sum()])]

    def parameters(self) -> list[np.ndarray]:
        return [self.bytes, self.filters, self.bias, self.top, self.offset]


def train(rows: list[tuple[bytes, int]], epochs: int = 8, batch_docs: int = 24, rate: float = 0.02, seed: int = 9) -> ByteNet:
    """Adam over whole documents.  Without rows, or rows of one label only, the offset alone says so."""
    net = ByteNet.fresh(seed)
    label = np.array([y for _, y in rows], float)
    if not rows or label.min() == label.max():
        net.top[:] = 0
        net.offset[:] = 0 if not rows else 4 * (2 * label[0] - 1)
        return net
    rare = len(rows) / 2 / np.array([(label == 0).sum(), (label == 1).sum()])
    weight = np.sqrt(rare)[label.astype(int)]  # halfway towards equal classes
    draw = np.random.default_rng(seed)
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    step = 0
    for epoch in range(epochs):
        order = draw.permutation(len(rows))
        for k in range(0, len(rows), batch_docs):
            some = order[k : k + batch_docs]
            step += 1
            now = rate * min(1, 2 * (1 - epoch / epochs))
            for p, g, m, v in zip(net.parameters(), net.train_step(Layout.of([rows[i][0] for i in some]), label[some], weight[some]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def fit_quality(labelled: DataFrame, sample_rows: int = 1500, seed: int = 13) -> ByteNet:
    """A network from rows (doc_id, text, quality): those of the sample_rows ids of smallest hash, in one task."""
    rows = sample_by_id(labelled.select("doc_id", "text", "quality").where("quality in (0, 1)"), sample_rows, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(b["doc_id"].to_pylist(), texts(b["text"]), b["quality"].to_pylist(), strict=True)]
        got.sort(key=lambda r: (hashlib.blake2b(str(r[0]).encode()).digest(), r[1:]))
        yield pa.RecordBatch.from_pydict({"net": pa.array([pickle.dumps(vars(train([r[1:] for r in got[:sample_rows]])))], pa.binary())})

    found = rows.coalesce(1).mapInArrow(run, "net binary").first()  # none where there is no partition
    return ByteNet(**pickle.loads(found[0])) if found else train([])


def score_quality(docs: DataFrame, net: ByteNet) -> DataFrame:
    """docs plus score, the probability of label 1, and predicted, 1 from a half on.

    Whole texts, row by row, without a shuffle; null counts as empty, and an
    empty text is scored as WIDTH zero bytes.  A long text is read in chunks,
    in memory proportional to its length.  Repeated rows get equal scores, an
    empty table none.  score and predicted replace columns of those names;
    others pass untouched, whatever they are called.
    """
    columns, kinds = without(docs, "score", "predicted"), dict(docs.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(vars(net)))  # a few KB
    schema = ", ".join([*(f"{quoted(c)} {kinds[c]}" for c in columns), "score double", "predicted int"])
    passed = docs.select(*map(quoted, columns), F.col("text").cast("string").alias(fresh(docs, "text")[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ByteNet(**pickle.loads(sent.value))
        for b in pieces(batches, len(columns)):
            s = own.scores(texts(b.column(len(columns))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[*columns, "score", "predicted"])

    return passed.mapInArrow(run, schema)
