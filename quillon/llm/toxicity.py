"""Toxicity: a linear classifier whose score may not hang on which group a sentence names.

Features are the words of a text and the first 4 and 5 bytes of its longer words.
In every labelled sentence that names a group, each identity term is swapped for every
other of its list, and for none; squared changes of the score join the loss, so the
weights of a list's terms are driven together, and to that of naming nobody.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BYTE, POS, Words, chunks, labelled, member, mix, sieve, type_of, words

MAX_TRAIN, RIDGE, SWAP, SURE, STEPS = 20_000, 1e-4, 1.0, 4.0, 100
#: Pairs of text and feature that are worked on at once.
BLOCK = 1 << 20
#: Lists of interchangeable identity terms.
IDENTITY = (
    ("person", "woman", "man", "transgender", "gay", "lesbian", "straight", "bisexual", "queer"),
    ("people", "women", "men", "gays", "lesbians", "immigrants", "refugees", "foreigners"),
    ("believer", "muslim", "christian", "jew", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("citizen", "african", "asian", "european", "mexican", "arab", "chinese", "indian", "german", "french", "black", "white", "latino"),
    ("adult", "elderly", "teenager", "disabled", "deaf", "blind"),
)
_SENTENCE = re.compile(r"[^.!?\n]+")


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature hash), each once for a text, sorted by text."""
    doc, out = w.doc, [w.hashes]
    own, size = [doc], w.ends - w.starts
    for n in (4, 5):
        at = np.flatnonzero(size > n)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h += BYTE[w.data[w.starts[at] + i]] * POS[i]
        out.append(mix(h ^ np.uint64(0xABCDEF)))
        own.append(doc[at])
    h, d = np.concatenate(out), np.concatenate(own)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[keep], h[keep]


@dataclass
class Linear:
    terms: np.ndarray  # sorted feature hashes
    weight: np.ndarray
    bias: float

    def score(self, col: pa.Array) -> np.ndarray:
        """Probability that each text is toxic; of an empty or null one, that of no features."""
        w = words(col)
        total, bloom = np.full(len(w.ptr) - 1, self.bias), sieve(self.terms)
        doc, h = features(w)
        at = member(h, self.terms, bloom)
        ok = at >= 0
        total += np.bincount(doc[ok], self.weight[at[ok]], len(total))
        return 1 / (1 + np.exp(-total))


def swaps(text: str, identity: tuple[tuple[str, ...], ...] = IDENTITY) -> list[tuple[str, str]]:
    """(sentence, sentence with one identity term swapped), for each term and each other of its list, and for none."""
    groups = {t: g for g in identity for t in g}
    out = []
    for s in _SENTENCE.findall(text.lower()):
        found = re.findall(r"\w+", s)
        for t in dict.fromkeys(x for x in found if x in groups):
            out += [(s, re.sub(rf"\b{t}\b", u, s)) for u in (*groups[t], "") if u != t]
    return out


def effects(pairs: list[tuple[str, str]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each (sentence, swapped sentence): the features only the one and only the other has."""
    if not pairs:
        return []
    sides = [features(words(pa.array(s, pa.large_string()))) for s in zip(*pairs, strict=True)]
    sets = [[h[np.searchsorted(d, i) : np.searchsorted(d, i, side="right")] for i in range(len(pairs))] for d, h in sides]
    return [(np.setdiff1d(a, b), np.setdiff1d(b, a)) for a, b in zip(*sets, strict=True)]


def run_sums(values: np.ndarray, at: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Sums of ``values[at]`` over the runs that begin at ``heads``, some runs at a time."""
    out, ends = np.empty(len(heads)), np.append(heads[1:], len(at))
    lo = 0
    while lo < len(heads):
        hi = max(lo + 1, int(np.searchsorted(ends, heads[lo] + BLOCK, side="right")))
        out[lo:hi] = np.add.reduceat(values[at[heads[lo] : ends[hi - 1]]], heads[lo:hi] - heads[lo])
        lo = hi
    return out


def fit(doc: np.ndarray, feature: np.ndarray, y: np.ndarray, touched: list[tuple[np.ndarray, np.ndarray]], swap: float = SWAP, steps: int = STEPS) -> Linear:
    """Logistic regression on (text, feature) pairs, classes of equal weight; a constant where there is one class.

    Every feature takes part, at a scale by the evidence that it differs between the
    classes: the square of its z-score over ``SURE``, one at most, so that a word seen once
    hardly moves the score however many such words there are.
    """
    if len(np.unique(y)) < 2:
        return Linear(np.zeros(0, np.uint64), np.zeros(0), 20.0 if len(y) and y[0] else -20.0)
    n1, n0 = y.sum(), len(y) - y.sum()
    chosen = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for t in touched for x in t)]))
    for i in range(0, len(feature), BLOCK):
        chosen = np.union1d(chosen, feature[i : i + BLOCK])
    f = np.empty(len(feature), np.int32)
    for i in range(0, len(f), BLOCK):
        f[i : i + BLOCK] = np.searchsorted(chosen, feature[i : i + BLOCK])
    del feature  # the arrays of pairs are the memory of this function: each goes when the next is there
    own, texts = np.unique(doc, return_index=True)  # pairs come sorted by text, so sums over each text and each feature are sums of runs
    key = f.astype(np.uint64) << np.uint64(32)
    key |= doc.astype(np.uint32)
    del doc
    key.sort()
    by_feature = np.empty(len(key), np.int32)
    c, c1 = np.zeros(len(chosen)), np.zeros(len(chosen))
    for i in range(0, len(key), BLOCK):
        of = (key[i : i + BLOCK] >> np.uint64(32)).astype(np.int64)
        by_feature[i : i + BLOCK] = key[i : i + BLOCK] & np.uint64(0xFFFFFFFF)
        c += np.bincount(of, minlength=len(chosen))
        c1 += np.bincount(of, y[by_feature[i : i + BLOCK]], len(chosen))
    del key
    there = np.flatnonzero(c)
    heads = np.concatenate((np.zeros(1, np.int64), np.cumsum(c[there])[:-1].astype(np.int64))) if len(there) else np.zeros(0, np.int64)
    row = np.array([i for i, t in enumerate(touched) for side in t for _ in side], np.int64)
    col = np.searchsorted(chosen, np.concatenate([np.zeros(0, np.uint64), *(x for t in touched for x in t)]))
    sign = np.array([s for t in touched for s, side in zip((1.0, -1.0), t, strict=True) for _ in side])
    p = c / len(y)
    z = (c1 / n1 - (c - c1) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    scale = np.minimum(1, (z / SURE) ** 2)
    w, bias = np.zeros(len(chosen)), 0.0
    m1, m2, share = np.zeros(len(w) + 1), np.zeros(len(w) + 1), np.where(y > 0, 0.5 / n1, 0.5 / n0)
    for k in range(1, steps + 1):
        v = scale * w
        total = np.full(len(y), bias)
        total[own] += run_sums(v, f, texts)
        r = (1 / (1 + np.exp(-total.clip(-50, 50))) - y) * share
        g = np.zeros(len(w))
        g[there] = run_sums(r, by_feature, heads)
        if len(touched):
            change = np.bincount(row, sign * v[col], len(touched))
            g += 2 * swap / len(touched) * np.bincount(col, sign * change[row], len(w))
        g = scale * g + RIDGE * w
        g = np.append(g, r.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = 0.1 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Linear(chosen, scale * w, float(bias))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, identity: tuple[tuple[str, ...], ...] = IDENTITY, swap: float = SWAP) -> Linear:
    """Fit on the labelled documents, at most ``max_train`` of them: those of the smallest id hashes.

    All features of their whole texts count, and all their sentences that name a group are
    swapped: what is collected is bounded by ``max_train`` documents.  Repeated rows of an
    id, and repeated or contradicting labels (the higher counts), make one row; rows with a
    null id, label or text, and labels without a document, make none and do not use up
    ``max_train``.  An empty text is a row without features; other columns are ignored.
    Where nothing is left, or one class, the model is a constant (nothing: not toxic) and a
    warning is given.
    """
    named = re.compile(r"\b(?:" + "|".join(re.escape(t) for g in identity for t in g) + r")\b", re.I)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            d, h = features(words(b.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(b.num_rows + 1)).astype(np.int32)), pa.array(h.view(np.int64)))
            texts = ["\n".join(s for s in _SENTENCE.findall(t) if named.search(s)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), lists, pa.array(texts, pa.string())], ["id", "y", "h", "named"])

    got = labelled(docs, labels, "toxic", max_train, 1).mapInArrow(run, "id long, y double, h array<long>, named string").toArrow()
    order = np.argsort(got.column("id").to_numpy())
    y, named_in = got.column("y").to_numpy()[order], got.column("named").to_pylist()
    length = np.concatenate([np.zeros(0, np.int64), *(c.value_lengths().to_numpy() for c in got.column("h").chunks)])[order]
    if len(np.unique(y)) < 2:
        warnings.warn(f"{len(y)} labelled documents of {len(np.unique(y))} classes: the toxicity model is a constant", stacklevel=2)
    pairs, begin = np.empty(int(length.sum()), np.uint64), np.empty(len(y), np.int64)
    begin[order] = np.cumsum(length) - length
    at = 0
    for c in got.column("h").chunks:  # each row's features to its place by id
        values, ends = c.flatten().to_numpy().view(np.uint64), np.cumsum(c.value_lengths().to_numpy())
        for lo, hi in zip(np.concatenate(([0], ends[:-1])), ends, strict=True) if len(ends) else ():
            pairs[begin[at] : begin[at] + hi - lo] = values[lo:hi]
            at += 1
        del values
    del got
    touched = effects([x for i in order if named_in[i] for x in swaps(named_in[i], identity)])
    pa.default_memory_pool().release_unused()
    held = [pairs]
    del pairs
    return fit(np.repeat(np.arange(len(length), dtype=np.int32), length), held.pop(), y, touched, swap)


def score(docs: DataFrame, model: Linear) -> DataFrame:
    """(doc_id, toxicity, toxic) for each row: the model's probability, and whether it is 0.5 or more.

    A null text counts as empty; a null id stays null; repeated rows get a row each, equal
    texts equal values; texts of any length are read whole; an empty table gives an empty
    result; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            p = np.round(held.value.score(b.column("text")), 6)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array(p >= 0.5)], ["doc_id", "toxicity", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, toxicity double, toxic boolean")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
