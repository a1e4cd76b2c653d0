"""Shared plumbing: scratch tables in the cluster's shared folder, Arrow batches, word hashes.

A *word* is, in every operator here, a maximal run of ASCII letters, digits and
``_`` or of characters from U+00C0 on, without the punctuation blocks
U+2000-2BFF and U+3000-303F (as a regular expression: ``WORD``), in lower case.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[0-9A-Za-z_\x{C0}-\x{1FFF}\x{2C00}-\x{2FFF}\x{3040}-\x{10FFFF}]+"

_made: dict[str, SparkSession] = {}
_held: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where unset, and only on a local master, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    _held[out] = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialise`` wrote and nothing reads any more; others are left alone."""
    for t in tables:
        path = None if t is None else _held.pop(t, None)
        if path in _made:
            delete_path(_made.pop(path), path)


def drop_scratch() -> None:
    """Delete the tables that ``materialise`` wrote; results that still read them become unreadable."""
    while _made:
        path, spark = _made.popitem()
        try:
            delete_path(spark, path)
        except Exception:  # the session has ended: the cluster clears its folder
            return


atexit.register(drop_scratch)


def type_of(df: DataFrame, column: str) -> str:
    """The type of a column as DDL; ids keep the type they come in."""
    return df.schema[column].dataType.simpleString()


def labelled(docs: DataFrame, labels: DataFrame, column: str, most: int, positive: int) -> DataFrame:
    """(id, text, y): labelled documents, ``most`` rows at most, those of the smallest id hashes; id is a hash.

    A label that names no document with a text is no row; of the texts of one id that of the
    smallest hash counts, once; of contradicting labels ``positive`` (0 or 1).
    """
    label = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).select(F.xxhash64(F.col("doc_id").cast("string")).alias("id"), F.col(column).cast("double").alias("y"))
    label = label.groupBy("id").agg((F.max if positive else F.min)("y").alias("y"))
    rows = docs.where("doc_id is not null and text is not null").select(F.xxhash64(F.col("doc_id").cast("string")).alias("id"), F.xxhash64("text").alias("body"), "text")
    there = rows.select("id", "body").join(label, "id").groupBy("id").agg(F.min("body").alias("body"), F.first("y").alias("y"))
    sample = there.orderBy("id").limit(most)
    return rows.join(F.broadcast(sample), ["id", "body"]).dropDuplicates(["id"]).select("id", "text", "y")  # a sample of ``most`` rows


def even_slots(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions a number (a bigint) that ``repartition(n, ...)`` puts there: hashing 0 to n - 1 would leave a third of them empty."""
    found = spark.range(40 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("part")).agg(F.min("id").alias("slot")).collect()
    slots = {r["part"]: r["slot"] for r in found}
    return [slots.get(k, k) for k in range(n)]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches holding about ``limit`` bytes of text each (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(np.maximum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False), 1))
        lo = 0
        while lo < b.num_rows:
            base = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POS = _rng.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ISWORD = np.zeros(256, bool)
_ISWORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True


@dataclass
class Words:
    data: np.ndarray  # bytes of the lower-cased texts, one after the other
    offsets: np.ndarray  # where each text begins, and the end
    starts: np.ndarray  # byte range of each word
    ends: np.ndarray
    hashes: np.ndarray  # uint64 of each word
    ptr: np.ndarray  # where each text's words begin, and the end

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls."""
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def words(col: pa.Array, lower: bool = True) -> Words:
    """Words of a string column, vectorised over the UTF-8 bytes; null counts as empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    data, off = string_bytes(pc.utf8_lower(col) if lower else col)
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(data, off, z, z, np.zeros(0, np.uint64), np.zeros(len(off), np.int64))
    isw = _ISWORD[data]
    if (data >= 0xC2).any():
        at = np.flatnonzero(data == 0xC2)
        isw[at] = isw[np.minimum(at + 1, n - 1)] = False
        for lead, lo, hi in ((0xE2, 0x80, 0xAF), (0xE3, 0x80, 0x80)):
            at = np.flatnonzero(data == lead)
            at = at[at + 2 < n]
            at = at[(data[at + 1] >= lo) & (data[at + 1] <= hi)]
            isw[at] = isw[at + 1] = isw[at + 2] = False
    first = isw.copy()
    first[1:] &= ~isw[:-1]
    cut = off[:-1][off[:-1] < n]
    first[cut] = isw[cut]
    last = isw.copy()
    last[:-1] &= ~isw[1:]
    cut = cut[cut > 0] - 1
    last[cut] = isw[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(starts):
        size = ends - starts
        body = data[isw]
        heads = np.concatenate(([0], np.cumsum(size)[:-1]))
        pos = np.arange(len(body)) - np.repeat(heads, size)
        h = np.add.reduceat(BYTE[body] * POS[pos & 4095], heads)
        h = mix(h + size.astype(np.uint64))
    else:
        h = np.zeros(0, np.uint64)
    return Words(data, off, starts, ends, h, np.searchsorted(starts, off))


def hash_words(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of each of a few texts."""
    w = words(pa.array(texts, pa.large_string()))
    return [w.hashes[a:b] for a, b in zip(w.ptr[:-1], w.ptr[1:], strict=True)]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word sequences that begin at each word (as many as fit)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return mix(out)


def member(values: np.ndarray, table: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    """Index into sorted ``table`` of each value, or -1; ``bloom`` is ``sieve(table)``."""
    out = np.full(len(values), -1, np.int64)
    at = np.flatnonzero(bloom[(values & np.uint64(len(bloom) - 1)).astype(np.int64)])
    if len(at) and len(table):
        i = np.minimum(np.searchsorted(table, values[at]), len(table) - 1)
        ok = table[i] == values[at]
        out[at[ok]] = i[ok]
    return out


def sieve(table: np.ndarray) -> np.ndarray:
    """A bit per low part of the hashes in ``table``, for ``member``."""
    size = 1 << max(16, int(np.ceil(np.log2(max(1, len(table)) * 16))))
    out = np.zeros(size, bool)
    out[(table & np.uint64(size - 1)).astype(np.int64)] = True
    return out
