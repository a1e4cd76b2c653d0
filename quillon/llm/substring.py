"""Substring dedup: passages of at least ``MIN_WORDS`` words that recur across documents.

Each window of MIN_WORDS words has one anchor, the word sequence of ANCHOR words in it
with the smallest hash, so equal windows have equal anchors wherever they stand.
1. Every document is cut at its anchors; anchors seen in two documents or more are kept.
2. Equal stretches of one anchor are collapsed before they are shuffled, and the windows
   found in two documents are confirmed, for each anchor by itself, or, where an anchor
   has over ``HOT`` different stretches, by aggregation over all windows.  The first and
   the last of each confirmed run become phrases.
3. Phrases are compiled into Aho-Corasick automata, a shard of anchors each, and all
   documents stream through them, each stretch through the automaton that holds its
   anchor; the automata tell every occurrence.  An anchor with more stretches than a
   shard holds is salted: its phrases go to several shards, each stretch to one.
An anchor's windows begin within MIN_WORDS - ANCHOR + 1 words of each other, so two
phrases cover a run; occurrences are thus exactly the windows that recur.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, discard, grams, materialise, mix, type_of, words

MIN_WORDS, ANCHOR = 50, 8
SHARD_ROWS, HOT = 12_000, 100_000


def anchors(h: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Of texts given as word hashes: for each run of windows with one anchor, its text, first and last window, and the anchor's hash."""
    none = np.zeros(0, np.int64)
    if len(h) < n:
        return none, none, none, np.zeros(0, np.uint64)
    g = grams(h, ANCHOR)
    key = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)  # equal hashes: the first
    low, width, want = key, 1, n - ANCHOR + 1
    while 2 * width <= want:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    if width < want:
        low = np.minimum(low[: len(low) - (want - width)], low[want - width :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    start = np.flatnonzero(doc[: len(at)] == doc[n - 1 : n - 1 + len(at)])
    if not len(start):
        return none, none, none, np.zeros(0, np.uint64)
    a, d = at[start], doc[start]
    head = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (d[1:] != d[:-1]))))
    last = np.append(head[1:], len(start)) - 1
    return d[head], start[head], start[last], g[a[head]]


def windows(flat: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on, by doubling."""
    low, width = flat.view(np.uint32).astype(np.uint64), 1
    low = low * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    full, done = None, 0
    while done < n:
        if (n >> (width.bit_length() - 1)) & 1:
            full = low if full is None else full[: len(low) - done if len(low) > done else 0] * np.uint64(0xD6E8FEB86659FD93) + low[done : done + len(full)]
            done += width
        if done < n:
            low = low[:-width] * np.uint64(0xC2B2AE3D27D4EB4F) ^ (low[width:] >> np.uint64(7)) + low[width:] * np.uint64(0x165667B19E3779F9)
            width *= 2
    return full


def _lists(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _spans(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches: all their words, where each begins (and the end), the places that windows begin at, and their stretches."""
    size = column.value_lengths().to_numpy()
    flat, off = column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(size)))
    own = np.repeat(np.arange(len(size)), size)
    start = np.flatnonzero(own[: len(flat) - n + 1] == own[n - 1 :]) if len(flat) >= n else np.zeros(0, np.int64)
    return flat, off, start, own[start]


def _phrases(anchor: np.ndarray, flat: np.ndarray, start: np.ndarray, own: np.ndarray, key: np.ndarray, n: int) -> pa.Table:
    """(anchor, words): the first and last of each run of confirmed windows, given by place, stretch and hash, once each."""
    if len(start):
        new = np.concatenate(([True], (start[1:] != start[:-1] + 1) | (own[1:] != own[:-1])))
        pick = np.flatnonzero(new | np.append(new[1:], True))
        _, once = np.unique(np.stack([anchor[own[pick]].view(np.uint64), key[pick]], 1), axis=0, return_index=True)
        start, own = start[pick[once]], own[pick[once]]
    values = pa.array(flat[(start[:, None] + np.arange(n)).ravel()], pa.int32())
    lists = pa.ListArray.from_arrays(pa.array((np.arange(len(start) + 1) * n).astype(np.int32)), values)
    return pa.table({"anchor": pa.array(anchor[own], pa.int64()), "words": lists})


def confirm(rows: pa.Table, n: int) -> pa.Table:
    """Phrases of the windows that several documents hold, among different stretches with the least and greatest document of each."""
    flat, _, start, own = _spans(_lists(rows.column("words")), n)
    anchor, lo, hi = (rows.column(c).to_numpy() for c in ("anchor", "lo", "hi"))
    if not len(start):
        return _phrases(anchor, flat, start, own, np.zeros(0, np.uint64), n)
    key = windows(flat, n)[start]
    order = np.lexsort((key, anchor[own]))
    k, a = key[order], anchor[own][order]
    head = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (a[1:] != a[:-1]))))
    several = np.minimum.reduceat(lo[own][order], head) < np.maximum.reduceat(hi[own][order], head)
    ok = np.zeros(len(start), bool)
    ok[order] = np.repeat(several, np.diff(np.append(head, len(k))))
    return _phrases(anchor, flat, start[ok], own[ok], key[ok], n)


def _hot_phrases(hot: DataFrame, n: int) -> DataFrame:
    """As ``confirm``, for anchors of any number of stretches: windows are counted by an aggregation, whose keys are spread."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, off, start, own = _spans(b.column("words"), n)
            key = windows(flat, n)[start] if len(start) else np.zeros(0, np.uint64)
            each = [b.column(c).take(pa.array(own)) for c in ("anchor", "stretch", "lo", "hi")]
            yield pa.RecordBatch.from_arrays([*each, pa.array((start - off[own]).astype(np.int32)), pa.array(key.view(np.int64))], ["anchor", "stretch", "lo", "hi", "at", "window"])

    every = materialise(hot.mapInArrow(spread, "anchor long, stretch long, lo long, hi long, at int, window long"), "windows")
    several = every.groupBy("anchor", "window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("anchor", "window")
    places = every.join(several, ["anchor", "window"]).groupBy("anchor", "stretch").agg(F.collect_set("at").alias("at"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, off, start, own = _spans(b.column("words"), n)
            at = b.column("at")
            good = np.sort(off[np.repeat(np.arange(b.num_rows), at.value_lengths().to_numpy())] + at.flatten().to_numpy())
            ok = np.isin(start, good)
            key = windows(flat, n)[start] if len(start) else np.zeros(0, np.uint64)
            yield from _phrases(b.column("anchor").to_numpy(), flat, start[ok], own[ok], key[ok], n).to_batches()

    out = materialise(hot.join(places, ["anchor", "stretch"]).mapInArrow(pick, "anchor long, words array<int>").distinct(), "phrases")
    discard(every)
    return out


def locate(phrases: pa.Table, rows: pa.Table, n: int) -> pa.Table:
    """(doc_id, begin, end in words) of every occurrence of a shard's phrases in the stretches that stream through its automaton."""
    auto = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for p in np.unique(_lists(phrases.column("words")).flatten().to_numpy().view(np.uint32).reshape(-1, n), axis=0).tolist():
        auto.add_word(tuple(p))
    auto.make_automaton()
    column = _lists(rows.column("words"))
    off = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
    view = column.flatten().to_numpy().view(np.uint32)
    ends, owner = [], []
    if len(auto):
        for i in range(len(column)):
            hits = [e for e, _ in auto.iter(tuple(view[off[i] : off[i + 1]].tolist()))]
            ends += hits
            owner += [i] * len(hits)
    last, own = np.array(ends, np.int64), np.array(owner, np.int64)
    base = rows.column("begin").to_numpy()[own]
    ids = rows.column("doc_id").combine_chunks().take(pa.array(own))
    return pa.table({"doc_id": ids, "begin": pa.array(base + last - (n - 1), pa.int64()), "end": pa.array(base + last + 1, pa.int64())})


def stretches(docs: DataFrame, n: int) -> DataFrame:
    """(anchor, doc, doc_id, begin, stretch, words) of every stretch of all documents whose anchor comes in two documents or more; doc is a hash of the id."""
    rows = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    kind = type_of(docs, "doc_id")

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = words(b.column("text"))
            d, _, _, a = anchors(w.hashes, w.ptr, n)
            pair = np.unique(np.stack([d, a.view(np.int64)], 1), axis=0) if len(d) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(pair[:, 0])), pa.array(pair[:, 1])], ["doc_id", "anchor"])

    marked = materialise(rows.mapInArrow(marks, f"doc_id {kind}, anchor long").withColumn("doc", F.xxhash64("doc_id")), "anchors")
    shared = marked.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("anchor")
    wanted = marked.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = words(b.column("text"))
            d, first, last, a = anchors(w.hashes, w.ptr, n)
            col = b.column("anchors")
            own = np.repeat(np.arange(len(col)), col.value_lengths().to_numpy())
            pair = lambda i, x: np.stack([i.astype(np.uint64), x], 1)
            have = pair(own, col.flatten().to_numpy().view(np.uint64))
            both = np.dtype([("d", np.uint64), ("a", np.uint64)])
            keep = np.flatnonzero(np.isin(np.ascontiguousarray(pair(d, a)).view(both).ravel(), np.ascontiguousarray(have).view(both).ravel()))
            d, first, last, a = d[keep], first[keep], last[keep], a[keep]
            size = last - first + n
            heads = np.concatenate(([0], np.cumsum(size)))
            place = np.arange(heads[-1]) - np.repeat(heads[:-1], size)
            h = w.hashes[np.repeat(first, size) + place]
            short = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(heads.astype(np.int32)), pa.array(short))
            whole = mix(np.add.reduceat(h * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), heads[:-1]) + size.astype(np.uint64)) if len(size) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), b.column("doc_id").take(pa.array(d)), pa.array(first - w.ptr[d]), pa.array(whole.view(np.int64)), lists], ["anchor", "doc_id", "begin", "stretch", "words"])

    found = rows.join(wanted, "doc_id").mapInArrow(cut, f"anchor long, doc_id {kind}, begin long, stretch long, words array<int>")
    out = materialise(found.withColumn("doc", F.xxhash64("doc_id")), "stretches")
    discard(marked)
    return out


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, begin, end) of every stretch of text made of passages that recur across documents.

    begin and end count words of the text (see ``common``); a stretch is a union of
    overlapping windows of ``min_words`` words each of which stands in two documents or
    more.  Texts are read whole, of any length.  Texts under ``min_words`` words, empty
    ones, and rows with a null id or text, have none; repeated rows of one id count as one
    document; an empty table gives an empty result; other columns are ignored.  Ids may be
    of any type.
    """
    n, kind = min_words, type_of(docs, "doc_id")
    found = stretches(docs, n)
    same = materialise(found.groupBy("anchor", "stretch").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.first("words").alias("words")), "different")
    hot = materialise(same.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor"), "hot")
    some = not hot.isEmpty()
    cold = same.join(hot, "anchor", "left_anti") if some else same
    groups = max(1, -(-same.count() // SHARD_ROWS))
    phrases = cold.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups))).groupBy("group").applyInArrow(lambda t: confirm(t, n), "anchor long, words array<int>")
    counted = [_hot_phrases(same.join(hot, "anchor"), n)] if some else []
    phrases = materialise(phrases.union(counted[0]) if some else phrases, "phrases")
    shards = max(1, -(-found.count() // SHARD_ROWS))
    salts = materialise(found.groupBy("anchor").count().where(F.col("count") > SHARD_ROWS).select("anchor", F.ceil(F.col("count") / SHARD_ROWS).cast("int").alias("salts")), "salts")
    shard = lambda salt: F.pmod(F.xxhash64("anchor", salt), F.lit(shards)).cast("int").alias("shard")
    salted = lambda df: df.join(salts, "anchor", "left").withColumn("salts", F.coalesce("salts", F.lit(1))) if not salts.isEmpty() else df.withColumn("salts", F.lit(1))
    sent = salted(phrases).select("anchor", "words", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select(shard("salt"), "words")
    held = salted(found).withColumn("salt", F.pmod(F.xxhash64("doc", "begin"), "salts").cast("int")).select(shard("salt"), "doc_id", "begin", "words")
    hits = sent.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(lambda p, t: locate(p, t, n), f"doc_id {kind}, begin long, end long")
    order = Window.partitionBy("doc_id").orderBy("begin", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.distinct().withColumn("new", F.coalesce(F.col("begin") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
    out = materialise(runs.groupBy("doc_id", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("run"), "repeats")
    discard(found, same, hot, phrases, salts, *counted)
    return out


def op7(spark, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
