"""Approximate nearest neighbours: an inverted file over clustered vectors.

Centroids are fitted on a bounded sample; every vector is stored under its nearest one.
A query reads only the cells of the centroids nearest to it and scores what it finds
there exactly, so what it returns is right and only a member may be missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that centroids are fitted on, those of the smallest id hashes; and the most centroids.
SAMPLE, MOST_CELLS, ROUNDS = 65_536, 4096, 12


def unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size == 0, 1, size)


def centroids(sample: np.ndarray, cells: int, seed: int = 42) -> np.ndarray:
    """Spherical k-means: unit vectors, of which each row of ``sample`` is near one; a cell that loses all takes a random row."""
    rng, x = np.random.default_rng(seed), unit(sample.astype(np.float32))
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)] if len(x) else x
    for _ in range(ROUNDS if len(x) else 0):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        lost = np.bincount(own, minlength=len(c)) == 0
        total[lost] = x[rng.integers(0, len(x), int(lost.sum()))]
        c = unit(total)
    return c


def fit(vectors: DataFrame, cells: int | None, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of (doc_id, vec) rows of one field, √n of them unless told; at most ``sample`` rows of the commonest length are collected."""
    rows = vectors.where("norm > 0")
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return np.zeros((0, 0), np.float32)
    d, n = sizes[0]
    held = rows.where(F.size("vec") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("vec").toArrow()
    x = held.column("vec").combine_chunks()
    x = pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
    return centroids(x.flatten().to_numpy().reshape(-1, d), min(MOST_CELLS, cells or max(1, round(n**0.5))))


def assign(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    """(field, cell, doc_id, vec, norm): every vector with its nearest centroid; those of another length get cell -1."""
    held = vectors.sparkSession.sparkContext.broadcast(c)  # MOST_CELLS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            col, cell = b.column("vec"), np.full(b.num_rows, -1, np.int32)
            ok = np.flatnonzero(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == m.shape[1]) if len(m) else []
            if len(ok):
                cell[ok] = (col.take(pa.array(ok)).flatten().to_numpy().reshape(len(ok), -1) @ m.T).argmax(1)
            yield pa.RecordBatch.from_arrays([b.column("field"), pa.array(cell), *(b.column(x) for x in ("doc_id", "vec", "norm"))], ["field", "cell", "doc_id", "vec", "norm"])

    kind = vectors.schema["doc_id"].dataType.simpleString()
    return vectors.select("field", "doc_id", "vec", "norm").mapInArrow(run, f"field string, cell int, doc_id {kind}, vec array<float>, norm double")


def nearest(c: np.ndarray, query: tuple[float, ...], probes: int) -> list[int]:
    """The cells to read for a query, nearest first."""
    if not len(c) or c.shape[1] != len(query):
        return []
    return [int(k) for k in np.argsort(-(c @ np.array(query, np.float32)), kind="stable")[:probes]]
