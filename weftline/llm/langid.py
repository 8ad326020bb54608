"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fresh, pieces, quoted, sample_by_id, slices, without

UNKNOWN = "und"
ORDERS = (1, 2, 3)


def gram_ids(points: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Hashed feature of the n-gram at each position that has one."""
    n = len(points) - order + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.full(n, order, np.uint64)
    for j in range(order):
        h = (h ^ points[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def document_counts(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of a whole text and their frequencies, which sum to 1."""
    points = code_points(text)
    ids, n = np.unique(np.concatenate([gram_ids(points, o, bits) for o in ORDERS]), return_counts=True)
    return ids, n / max(1, n.sum())


@dataclass
class LanguageModel:
    labels: list[str]
    bits: int
    idf: np.ndarray
    weights: np.ndarray  # features x labels, mostly zero
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> np.ndarray:
        """Of whole texts: the mean over all n-grams of idf times weights."""
        table = (self.idf[:, None] * self.weights).astype(np.float32)
        out = np.zeros((len(texts), len(self.labels)))
        lengths = []
        for i, j in slices([len(t) for t in texts], 1 << 18):
            points = [code_points(t) for t in texts[i:j]]
            sizes = np.array([len(p) for p in points])
            lengths.append(sum(np.maximum(0, sizes - o + 1) for o in ORDERS))
            starts, whole = np.cumsum(sizes) - sizes, np.concatenate(points)
            doc = np.repeat(np.arange(j - i), sizes)
            for o in ORDERS:
                ids = gram_ids(whole, o, self.bits)
                inside = doc[: len(ids)] == doc[o - 1 :]
                values = table[ids] * inside[:, None]
                full = np.flatnonzero((sizes > 0) & (starts < len(ids)))
                if len(full):
                    out[i + full] += np.add.reduceat(values, starts[full], axis=0, dtype=np.float64)
        total = np.concatenate(lengths) if lengths else np.zeros(0)
        return out / np.maximum(1, total)[:, None] + self.bias

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.labels:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        z = self.logits(texts) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        known = [any(map(str.isalpha, t)) for t in texts]
        best = p.argmax(axis=1)
        return [self.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], [float(p[i, b]) if k else 0.0 for i, (b, k) in enumerate(zip(best, known, strict=True))]


def train(rows: list[tuple[str, str]], bits: int = 16, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4, calibration: float = 0.2) -> LanguageModel:
    """Fit on (text, label) rows: follow the regularised leader per coordinate, then one temperature on held-back rows."""
    labels = sorted({lang for _, lang in rows})
    size, classes = 1 << bits, len(labels)
    model = LanguageModel(labels, bits, np.zeros(size), np.zeros((size, classes)), np.zeros(classes))
    if not rows:
        return model
    docs = [(*document_counts(text, bits), labels.index(lang)) for text, lang in rows]
    held = int(len(docs) * calibration) if len(docs) >= 10 else 0
    fit = docs[held:]
    seen = np.bincount(np.concatenate([d[0] for d in fit]), minlength=size)
    model.idf = np.log((1 + len(fit)) / (1 + seen)) + 1
    scale = 30.0  # frequencies are small; this only sets the unit of the weights
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def active(ids: np.ndarray) -> np.ndarray:
        w = -(z[ids] - np.sign(z[ids]) * l1) / ((beta + np.sqrt(n[ids])) / alpha + l2)
        return np.where(np.abs(z[ids]) > l1, w, 0)

    draw = np.random.default_rng(5)
    for _ in range(epochs):
        for k in draw.permutation(len(fit)):
            ids, tf, label = fit[k]
            ids, x = np.append(ids, size), np.append(tf * model.idf[ids] * scale, 1.0)
            w = active(ids)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p
            squared = g * g
            z[ids] += g - (np.sqrt(n[ids] + squared) - np.sqrt(n[ids])) / alpha * w
            n[ids] += squared
    w = active(np.arange(size + 1))
    model.weights, model.bias = w[:size] * scale, w[size]
    if held:
        raw = np.array([(tf * model.idf[ids]) @ model.weights[ids] + model.bias for ids, tf, _ in docs[:held]])
        truth = np.array([d[2] for d in docs[:held]])

        def loss(t: float) -> float:
            s = raw / t
            return float(np.mean(np.logaddexp.reduce(s, axis=1) - s[np.arange(held), truth]))

        model.temperature = float(min(np.exp(np.linspace(-3, 3, 121)), key=loss))
    return model


def fit_languages(labelled: DataFrame, sample_rows: int = 3000, seed: int = 3) -> LanguageModel:
    """A model from labelled rows (doc_id, text, lang): those of the sample_rows ids of smallest hash.

    The bounded sample trains in one task and only the model comes to the
    driver: 2^bits weights for each language of the sample.
    """
    rows = sample_by_id(labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null"), sample_rows, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for b in batches for r in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["lang"].to_pylist(), strict=True)), key=lambda r: (hash_text(r[0]), r[1]))[:sample_rows]
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(vars(train([r[1:] for r in got])))], pa.binary())})

    found = rows.coalesce(1).mapInArrow(run, "model binary").first()  # none where there is no partition
    return LanguageModel(**pickle.loads(found[0])) if found else train([])


def hash_text(x: object) -> bytes:
    return hashlib.blake2b(str(x).encode(), digest_size=8).digest()


def predict_languages(docs: DataFrame, model: LanguageModel, label_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs plus label_col and score_col.

    Whole texts count, each row by itself: nothing is shuffled.  A null text
    or one without a letter gets und and 0; so does every text if no row had a
    label.  Equal scores go to the language first in order.  Repeated rows get
    equal results, an empty table none; a long text takes memory proportional
    to its length.  label_col and score_col replace columns of those names; the
    others pass untouched, whatever they are called.
    """
    columns = without(docs, label_col, score_col)
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(vars(model)))
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"{quoted(c)} {kinds[c]}" for c in columns), f"{quoted(label_col)} string", f"{quoted(score_col)} double"])
    passed = docs.select(*map(quoted, columns), F.coalesce(F.col("text").cast("string"), F.lit("")).alias(fresh(docs, "text")[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(**pickle.loads(sent.value))
        for b in pieces(batches, len(columns)):
            labels, scores = own.predict(b.column(len(columns)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*columns, label_col, score_col])

    return passed.mapInArrow(run, schema)
