"""Quality classifier: histogram gradient-boosted trees over statistics of the whole text.

Trees are complete and flattened into arrays: node i of a tree has children 2i+1 and
2i+2, so that a batch of documents walks all trees with numpy indexing alone.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import chunks, labelled, mix, string_bytes, type_of, words

MAX_TRAIN, TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 20_000, 40, 4, 64, 0.2, 20, 1.0
_CLASSES = ["upper", "lower", "digit", "blank", "line", "stop", "comma", "bar", "shout", "symbol", "wide"]
_CLASS = np.full(256, 9, np.uint8)
for _k, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t", b"\n", b".?", b",;", b"|", b"!")):
    _CLASS[list(_bytes)] = _k
_CLASS[128:] = 10
FEATURES = ["words", "bytes_a_word", "short_words", "long_words", "distinct_words", "top_word", "same_as_last", "distinct_pairs", "words_a_stop", *(f"share_{c}" for c in _CLASSES)]


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text: how many distinct values, and how often the most frequent comes."""
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    head = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (d[1:] != d[:-1])))) if len(v) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(v)))
    top = np.zeros(n)
    np.maximum.at(top, d[head], count)
    return np.bincount(d[head], minlength=n), top


def statistics(col: pa.Array) -> np.ndarray:
    """(n, len(FEATURES)) float32 statistics of whole texts; zeros for an empty or null one."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    data, off = string_bytes(col)
    w = words(col)
    n = len(off) - 1
    size, count, doc = np.diff(off), np.diff(w.ptr), w.doc
    length = w.ends - w.starts
    kinds = np.bincount(np.repeat(np.arange(n) * 11, size) + _CLASS[data], minlength=11 * n).reshape(n, 11)
    some = np.maximum(count, 1)
    distinct, top = _distinct(doc, w.hashes, n)
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    pairs = np.bincount(doc[inner], minlength=n)
    distinct_pairs, _ = _distinct(doc[inner], mix(w.hashes[inner] * np.uint64(3) + w.hashes[inner + 1]), n)
    again = np.bincount(doc[inner[w.hashes[inner] == w.hashes[inner + 1]]], minlength=n)
    out = [
        np.log1p(count), np.bincount(doc, length, n) / some, np.bincount(doc[length <= 3], minlength=n) / some, np.bincount(doc[length >= 12], minlength=n) / some,
        distinct / some, top / some, again / some, distinct_pairs / np.maximum(pairs, 1), count / np.maximum(kinds[:, 5], 1),
        *(kinds / np.maximum(size, 1)[:, None]).T,
    ]
    return np.stack(out, 1).astype(np.float32)


@dataclass
class Trees:
    base: float
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # goes right where the value is greater
    leaf: np.ndarray  # (trees, leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.feature.shape[1]
        depth = int(np.log2(inner + 1))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.cut[t, at])
            total += self.leaf[t, at - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees for the logistic loss; with no rows or a single class, the constant that fits them (1 for none)."""
    inner = 2**depth - 1
    if len(np.unique(y)) < 2:
        p = 20.0 if not len(y) or y[0] else -20.0
        return Trees(p, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)))
    nf = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(nf)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)  # bin b: at most cuts[b]
    base = float(np.log(y.mean() / (1 - y.mean())))
    model = Trees(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1)))
    total = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h, node = y - p, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth):
            lo, k = 2**level - 1, 2**level
            key = ((node - lo)[:, None] * nf + np.arange(nf)) * BINS + binned
            hist = [np.bincount(key.ravel(), np.repeat(v, nf), k * nf * BINS).reshape(k, nf, BINS).cumsum(2) for v in (g, h, np.ones(len(y)))]
            (gl, hl, nl), (ga, ha, na) = hist, [v[:, :, -1:] for v in hist]
            gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
            gain[(nl < LEAST) | (na - nl < LEAST)] = -1
            best = gain.reshape(k, -1).argmax(1)
            for j in np.flatnonzero(gain.reshape(k, -1)[np.arange(k), best] > 1e-9):
                f, b = divmod(int(best[j]), BINS)
                if b < len(cuts[f]):
                    model.feature[t, lo + j], model.cut[t, lo + j] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(x)), model.feature[t, node]] > model.cut[t, node])
        at = node - inner
        model.leaf[t] = RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + RIDGE)
        total += model.leaf[t, at]
    return model


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees:
    """Fit on the labelled documents, at most ``max_train`` of them: those of the smallest id hashes.

    Repeated rows of an id, and repeated or contradicting labels (the lower counts), make
    one row; rows with a null id, label or text, and labels without a document, make none
    and do not use up ``max_train``.  An empty text is a row of zeros; texts of any length
    are read whole; other columns are ignored.  Where nothing is left, or one class, the
    model is a constant (nothing: keep all) and a warning is given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            x = statistics(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(list(x.astype(float)), pa.list_(pa.float64()))], ["id", "y", "x"])

    got = labelled(docs, labels, "quality", max_train, 0).mapInArrow(run, "id long, y double, x array<double>").toArrow()
    y, x = got.column("y").to_numpy(), np.array(got.column("x").to_pylist(), np.float32).reshape(-1, len(FEATURES))
    if len(np.unique(y)) < 2:
        warnings.warn(f"{len(y)} labelled documents of {len(np.unique(y))} classes: the quality model is a constant", stacklevel=2)
    order = np.argsort(got.column("id").to_numpy())
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, quality, kept) for each row: the model's probability, and whether it is 0.5 or more.

    A null text counts as empty; a null id stays null; repeated rows get a row each, equal
    texts equal values; texts of any length are read whole; an empty table gives an empty
    result; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            p = np.round(held.value.score(statistics(b.column("text"))), 6)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array(p >= 0.5)], ["doc_id", "quality", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, quality double, kept boolean")


def good_only(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The documents that the classifier, trained on them and ``labels``, keeps; all their columns.

    Each row is judged by its own text, whatever its id: null ids and repeated rows are no
    matter, and a null text counts as empty.  Without labelled documents all rows stay.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield b.filter(pa.array(np.round(held.value.score(statistics(b.column("text"))), 6) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
