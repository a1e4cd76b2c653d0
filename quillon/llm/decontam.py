"""Benchmark decontamination: BM25 index of test items, block-max WAND, overlap check.

Items are the indexed documents, every passage of every training text is a query.
Impacts are BM25 divided by the item's score for its own words, so that one
threshold in (0, 1] serves all items.  Two vectorised bounds rule out most passages of a
batch: the sum of their terms' largest impacts, and, for each item, what they hold of its
rarest terms plus all that its other terms could add.  The rest run block-max WAND: a
cursor on the posting list of each term, a pivot where the terms' largest impacts may
reach the threshold, blocks of postings skipped where their own largest impacts may not,
and exact scores at the pivots left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import chunks, grams, hash_words, member, sieve, type_of, words

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP = 0.6, 0.6
GRAM, PASSAGE, BLOCK, RARE = 3, 64, 8, 0.75
SHARD_BYTES = 16 << 20
COLUMNS = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: cut after the last ``?`` with words after it, else before the last sentences that have five words, at most half the item."""
    ask = text.rfind("?")
    if ask >= 0 and re.search(r"\w", text[ask:]) and re.search(r"\w", text[:ask]):
        return text[: ask + 1], text[ask + 1 :]
    total = len(text.split())
    for m in reversed(list(re.finditer(r"(?<=[.!?])\s+", text))):
        n = len(text[m.end() :].split())
        if n >= 5:
            if 2 * n <= total:
                return text[: m.start()], text[m.end() :]
            break
    spots = [m.start() for m in re.finditer(r"\S+", text)]
    at = spots[-max(1, total // 3)] if spots else 0
    return text[:at], text[at:]


@dataclass
class Index:
    ids: list
    terms: np.ndarray  # sorted word hashes
    sieve: np.ndarray
    ptr: np.ndarray  # postings of each term
    item: np.ndarray
    impact: np.ndarray
    top: np.ndarray  # largest impact of each term
    rare_ptr: np.ndarray  # of each term, the postings in which it is one of the item's rarest
    rare_item: np.ndarray
    rare_impact: np.ndarray
    rare_sum: np.ndarray  # of each item, the impacts of its rarest terms: RARE of its score at least
    block_ptr: np.ndarray  # blocks of BLOCK postings of each term
    block_last: np.ndarray  # the last item of each block
    block_top: np.ndarray  # the largest impact in it
    half: int  # a passage is two neighbouring runs of so many words
    parts: list[tuple[np.ndarray, np.ndarray]]  # hashed words of question and answer


def _sequences(h: np.ndarray) -> np.ndarray:
    return np.unique(grams(h, min(GRAM, max(1, len(h)))))


def build(items: list[tuple[object, str]], df: dict[int, int] | None = None, total: int | None = None, half: int = PASSAGE, avg: float | None = None) -> Index:
    """The index of items with a word; df, total and avg (words an item): over all shards of items, where there are several."""
    hashed = [h for h in hash_words([t for _, t in items])]
    full = [k for k, h in enumerate(hashed) if len(h)]
    ids = [items[k][0] for k in full]
    hashed = [hashed[k] for k in full]
    size = np.array([len(h) for h in hashed], float)
    pairs = [np.unique(h, return_counts=True) for h in hashed]
    flat = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.uint64)
    tf = np.concatenate([p[1] for p in pairs]).astype(float) if pairs else np.zeros(0)
    item = np.repeat(np.arange(len(ids)), [len(p[0]) for p in pairs])
    terms, term, count = np.unique(flat, return_inverse=True, return_counts=True)
    n = total or len(ids)
    dfs = count if df is None else np.array([df.get(int(t), 1) for t in terms.view(np.int64)])
    idf = np.log(1 + (n - dfs + 0.5) / (dfs + 0.5))
    avg = avg or (size.mean() if len(size) else 1.0)
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / avg))
    impact /= np.bincount(item, impact, len(ids))[item] if len(item) else 1
    order = np.lexsort((item, term))
    term, item, impact = term[order], item[order], impact[order]
    ptr = np.searchsorted(term, np.arange(len(terms) + 1))
    by_item = np.lexsort((term, dfs[term], item))
    owner, share = item[by_item], impact[by_item]
    before = np.concatenate(([0], np.cumsum(share)))[:-1]
    before -= before[np.searchsorted(owner, owner)]
    rare = np.sort(by_item[before < RARE])
    rare_ptr = np.searchsorted(term[rare], np.arange(len(terms) + 1))
    rare_sum = np.bincount(item[rare], impact[rare], len(ids))
    size_of = -(-np.diff(ptr) // BLOCK)
    block_ptr = np.concatenate(([0], np.cumsum(size_of)))
    heads = np.repeat(ptr[:-1] - block_ptr[:-1] * BLOCK, size_of) + np.arange(block_ptr[-1]) * BLOCK
    block_top = np.maximum.reduceat(impact, heads) if len(heads) else np.zeros(0)
    block_last = item[np.minimum(heads + BLOCK, np.repeat(ptr[1:], size_of)) - 1] if len(heads) else np.zeros(0, np.int64)
    top = np.maximum.reduceat(impact, ptr[:-1]) if len(terms) else np.zeros(0)
    cut = [hash_words(list(split_item(items[k][1]))) for k in full]
    parts = [(q, a) for q, a in cut]
    return Index(ids, terms, sieve(terms), ptr, item, impact, top, rare_ptr, item[rare], impact[rare], rare_sum, block_ptr, block_last, block_top, max(half, int(size.max(initial=0))), parts)


def retrieve(ix: Index, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """(item, score) of all items scoring at least ``threshold`` for the distinct terms of a passage: block-max WAND."""
    out: list[tuple[int, float]] = []
    theta = threshold - 1e-12
    # a cursor: current item, place in the postings, their end, largest impact, first block, block after the last
    live = [[int(ix.item[ix.ptr[t]]), int(ix.ptr[t]), int(ix.ptr[t + 1]), float(ix.top[t]), int(ix.block_ptr[t]), int(ix.block_ptr[t + 1]), int(ix.ptr[t])] for t in terms.tolist()]

    def seek(c: list, item: int) -> None:
        """Move a cursor to its first posting of ``item`` or a later one; blocks before it are not read."""
        block = c[4] + int(np.searchsorted(ix.block_last[c[4] : c[5]], item))
        lo = max(c[1], c[6] + (block - c[4]) * BLOCK)
        hi = min(c[2], lo + BLOCK)
        c[1] = lo + int(np.searchsorted(ix.item[lo:hi], item))
        c[0] = int(ix.item[c[1]]) if c[1] < c[2] else -1

    while live:
        live.sort()
        bound, p = 0.0, 0
        while p < len(live) and (bound := bound + live[p][3]) < theta:
            p += 1
        if p == len(live):
            break
        pivot = live[p][0]
        while p + 1 < len(live) and live[p + 1][0] == pivot:
            p += 1
        at = [c[4] + int(np.searchsorted(ix.block_last[c[4] : c[5]], pivot)) for c in live[: p + 1]]
        near = [(c, b) for c, b in zip(live, at, strict=False) if b < c[5]]
        if sum(float(ix.block_top[b]) for _, b in near) < theta:
            after = [int(ix.block_last[b]) + 1 for _, b in near] + [c[0] for c in live[p + 1 : p + 2]]
            target = max(pivot + 1, min(after, default=pivot + 1))
        elif live[0][0] == pivot:
            score = sum(float(ix.impact[c[1]]) for c in live[: p + 1])
            if score >= theta:
                out.append((pivot, score))
            target = pivot + 1
        else:
            target = pivot
        for c in live[: p + 1]:
            if c[0] < target:
                seek(c, target)
        live = [c for c in live if c[0] >= 0]
    return out


def edits(want: np.ndarray, passage: np.ndarray) -> int:
    """Words to replace, insert or leave out to turn ``want`` into the stretch of the passage most like it."""
    at = np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    for word in want:
        step = row + 1
        step[1:] = np.minimum(step[1:], row[:-1] + (passage != word))
        row = np.minimum.accumulate(step - at) + at
    return int(row.min())


def contained(ix: Index, i: int, passage: np.ndarray) -> tuple[float, float]:
    """Shares of the question and of the answer that the passage holds: of word sequences, or of words in order where that is more.

    A changed word breaks up to GRAM sequences, most of those of a short part, but is one edit.
    """
    have = [grams(passage, n) for n in range(1, GRAM + 1)]  # a part of under GRAM words is one shorter sequence

    def share(part: np.ndarray) -> float:
        if not len(part):
            return 1.0
        whole = max(float(np.isin(_sequences(part), h).mean()) for h in have)
        return whole if whole == 1 else max(whole, 1 - edits(part, passage) / len(part))

    question, answer = ix.parts[i]
    return share(question), share(answer)


def _hold_rare(ix: Index, term: np.ndarray, run: np.ndarray, has_next: np.ndarray, threshold: float) -> np.ndarray:
    """Which runs, each with the next, hold enough of the rarest terms of some item for it to reach the threshold."""
    n = ix.rare_ptr[term + 1] - ix.rare_ptr[term]
    at = np.repeat(ix.rare_ptr[term] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    pair = np.unique(np.stack([np.repeat(run, n), at], 1), axis=0)  # a term once a run; in both runs it counts twice, as a bound may
    back = pair[(pair[:, 0] > 0) & has_next[pair[:, 0] - 1]] - np.array([1, 0])
    pair = np.concatenate([pair, back])
    out = np.zeros(len(has_next), bool)
    if len(pair):
        key, inverse = np.unique(pair[:, 0] * len(ix.ids) + ix.rare_item[pair[:, 1]], return_inverse=True)
        held = np.bincount(inverse, ix.rare_impact[pair[:, 1]])
        out[key[held >= threshold - 1e-6 - (1 - ix.rare_sum[key % len(ix.ids)])] // len(ix.ids)] = True
    return out


def scan(ix: Index, col: pa.Array, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
    """(row, item, score, question overlap, answer overlap), the best passage of each row and item."""
    w = words(col)
    vid = member(w.hashes, ix.terms, ix.sieve)
    length = np.diff(w.ptr)
    runs = np.maximum(1, -(-length // ix.half))
    first = np.concatenate(([0], np.cumsum(runs)))
    doc = w.doc
    known = np.flatnonzero(vid >= 0)
    run = first[doc[known]] + (known - w.ptr[doc[known]]) // ix.half
    has_next = np.ones(first[-1], bool)
    has_next[first[1:] - 1] = False

    def paired(x: np.ndarray) -> np.ndarray:
        y = x.copy()
        y[:-1][has_next[:-1]] += x[1:][has_next[:-1]]
        return y

    hopeful = paired(np.bincount(run, ix.top[vid[known]], first[-1])) >= threshold
    need = hopeful.copy()
    need[1:] |= hopeful[:-1] & has_next[:-1]
    sub = need[run]
    if not sub.any():
        return []
    if threshold > 1 - ix.rare_sum.min(initial=1.0) + 1e-6:  # so each match holds some of its item's rarest terms
        hopeful &= _hold_rare(ix, vid[known[sub]], run[sub], has_next, threshold)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for s in np.flatnonzero(hopeful):
        d = int(np.searchsorted(first, s, side="right")) - 1
        lo = w.ptr[d] + (s - first[d]) * ix.half
        hi = min(w.ptr[d + 1], lo + 2 * ix.half)
        inside = vid[lo:hi]
        for i, score in retrieve(ix, np.unique(inside[inside >= 0]), threshold):
            q, a = contained(ix, i, w.hashes[lo:hi])
            if q >= overlap and a >= overlap:
                best[d, i] = max(best.get((d, i), (0.0, 0.0, 0.0)), (score, q, a))
    return [(d, i, *v) for (d, i), v in best.items()]


def shards(items: DataFrame, shard_bytes: int) -> Iterator[Index]:
    """Indexes of all items: one where their texts have ``shard_bytes`` or less, else one for each hash class of that size, under counts over all items."""
    spark = items.sparkSession
    items = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    n = max(1, -(-size // shard_bytes))
    counts, half, total, avg = None, PASSAGE, None, None
    if n > 1:

        def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches):
                w = words(b.column("text"))
                for x, y in zip(w.ptr[:-1], w.ptr[1:], strict=True):
                    h = np.unique(w.hashes[x:y])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array((y - x) * (np.arange(len(h)) == 0))], ["term", "n"])  # the item's length, once

        seen = items.select("text").mapInArrow(distinct, "term long, n long")
        counts = seen.groupBy("term").agg(F.count("*").alias("df"))
        longest, total, avg = seen.where("n > 0").agg(F.max("n"), F.count("*"), F.avg("n")).collect()[0]
        half = max(half, longest or 0)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        held: list[Row] = part.orderBy("item_id", "text").collect()  # of shard_bytes at most
        df = None
        if counts is not None:
            here = np.unique(np.concatenate([np.zeros(0, np.uint64), *hash_words([r["text"] for r in held])])).view(np.int64)
            mine = spark.createDataFrame([(int(t),) for t in here], "term long")
            df = {r["term"]: r["df"] for r in counts.join(mine, "term", "left_semi").collect()}
        yield build([(r["item_id"], r["text"]) for r in held], df, total, half, avg)


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) for every text holding a benchmark item.

    Passages are runs of 2h words every h words, h the longest item and 64 at least, so
    each item fits in one; texts of any length are read whole.  Items are broadcast when
    their texts have ``shard_bytes`` or less; beyond, they are hashed into shards of that
    size, each broadcast for a pass of its own, under counts over all items.  Rows with a
    null id or text and items without a word match nothing; of several matches, or of
    repeated rows of one id, the one of the best score counts; empty tables give an empty
    result; other columns are ignored.  Ids may be of any type.
    """
    rows = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    schema = f"doc_id {type_of(docs, 'doc_id')}, item_id {type_of(items, 'item_id')}, score double, question_overlap double, answer_overlap double"
    item_type = to_arrow_type(items.schema["item_id"].dataType)
    found = None
    for index in shards(items, shard_bytes):
        ix = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], ix=ix) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches):
                hits = scan(ix.value, b.column("text"), threshold, overlap)
                ids = b.column("doc_id").take(pa.array([h[0] for h in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([ix.value.ids[h[1]] for h in hits], item_type), *(pa.array([h[c] for h in hits], pa.float64()) for c in (2, 3, 4))], COLUMNS)

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(*COLUMNS[2:])).alias("best"))
    return best.select("doc_id", "item_id", *(F.round(f"best.{c}", 6).alias(c) for c in COLUMNS[2:]))


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents that hold no item; all their columns.

    Each row is judged by its own text, whatever its id, without a shuffle: rows with a
    null id go when their texts hold an item, repeated rows all go or all stay, null and
    empty texts stay; an empty table stays empty.
    """
    for index in shards(items, shard_bytes):
        ix = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], ix=ix) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches):
                keep = np.ones(b.num_rows, bool)
                keep[[h[0] for h in scan(ix.value, b.column("text"), threshold, overlap)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
