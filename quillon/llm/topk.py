"""Exact top-k search: an impact-ordered index, read score at a time.

The words of all queries are looked up in every document once; the postings go to a
table.  Blocks of documents are then indexed in memory: postings of a word are sorted
into segments by quantised impact.  For a query, segments are read by descending impact
until no document outside the set of possible members can reach the k-th best lower
bound; those members are then scored exactly.  Each block starts from the k-th score
that the task has already reached.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import WORD, chunks, hash_words, materialise, member, sieve, type_of, words

K, K1, B = 10, 1.2, 0.75
LEVELS, BLOCK_DOCS = 64, 32768
SHARD_BYTES = 16 << 20


class Block:
    """Impact-ordered index of a block of documents, as postings sorted by document."""

    def __init__(self, ids: np.ndarray, ptr: np.ndarray, term: np.ndarray, impact: np.ndarray, top: float, n_terms: int):
        self.ids, self.ptr, self.term, self.impact = ids, ptr, term, impact
        self.rank = np.unique(ids, return_inverse=True)[1] if len(ids) else np.zeros(0, np.int64)  # ids may be strings
        self.step = top / LEVELS if top > 0 else 1.0
        level = np.ceil(impact / self.step).astype(np.int64)  # impact is in ((level - 1) * step, level * step]
        doc = np.repeat(np.arange(len(ids)), np.diff(ptr))
        order = np.lexsort((doc, -level, term))
        self.doc, t, q = doc[order], term[order], level[order]
        head = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (q[1:] != q[:-1])))) if len(t) else np.zeros(0, np.int64)
        self.begin, self.end = head, np.append(head[1:], len(t)) if len(t) else head
        self.level = q[head]
        self.segments = np.searchsorted(t[head], np.arange(n_terms + 1))

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, floor: float) -> list[tuple[float, object]]:
        """The k best (score, id) of at least ``floor``, scores rounded to 6 places, ties by id."""
        lists = [(s, int(m)) for t, m in zip(terms, times, strict=True) for s in range(self.segments[t], self.segments[t + 1])]
        if not lists:
            return []
        seg, mult = np.array([x[0] for x in lists]), np.array([x[1] for x in lists])
        bound = self.level[seg] * mult
        order = np.argsort(-bound, kind="stable")
        owner = np.repeat(np.arange(len(terms)), [self.segments[t + 1] - self.segments[t] for t in terms])
        left = np.zeros(len(terms), np.int64)  # the next level of each word
        np.maximum.at(left, owner, bound)
        after = np.append(bound[1:], 0)
        after[np.append(owner[1:] != owner[:-1], True)] = 0
        upper, lower = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        done = 0
        for done, j in enumerate(order, 1):
            d = self.doc[self.begin[seg[j]] : self.end[seg[j]]]
            upper[d] += bound[j]
            lower[d] += bound[j] - mult[j]
            left[owner[j]] = after[j]
            if done % 16 == 0:
                rest = left.sum()
                best = max(floor / self.step, np.partition(lower, -k)[-k] if len(lower) > k else 0.0)
                if rest < best - 1e-3 and np.count_nonzero(upper + rest >= best - 1e-3) <= 4 * k:
                    break
        rest = left.sum()
        best = max(floor / self.step, np.partition(lower, -k)[-k] if len(lower) > k else 0.0)
        member_ = np.flatnonzero((upper > 0 if done == len(order) else True) & (upper + rest >= best - 1e-3))
        weight = np.zeros(len(self.segments) - 1)
        weight[terms] = times
        n = self.ptr[member_ + 1] - self.ptr[member_]
        member_, n = member_[n > 0], n[n > 0]
        if not len(member_):
            return []
        heads = np.concatenate(([0], np.cumsum(n)[:-1]))
        at = np.repeat(self.ptr[member_] - heads, n) + np.arange(n.sum())
        score = np.round(np.add.reduceat(self.impact[at] * weight[self.term[at]], heads), 6)
        ok = np.flatnonzero((score >= floor) & (score > 0))
        best_rows = ok[np.lexsort((self.rank[member_[ok]], -score[ok]))[:k]]
        return [(float(score[i]), self.ids[member_[i]]) for i in best_rows]


def _postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, dl (words), terms (places in the vocabulary) and tfs of each document."""
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, sieve(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, bloom = held.value
        for b in chunks(batches):
            w = words(b.column("text"))
            at = member(w.hashes, terms, bloom)
            ok = at >= 0
            pair, tf = np.unique(w.doc[ok] * max(1, len(terms)) + at[ok], return_counts=True)
            doc, term = pair // max(1, len(terms)), pair % max(1, len(terms))
            off = pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(np.int32))) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(w.ptr)), *lists], ["doc_id", "dl", "terms", "tfs"])

    return docs.mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, dl long, terms array<int>, tfs array<int>")


def search(docs: DataFrame, queries: DataFrame, k: int = K, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(item_id, doc_id, score, rank): the k best documents of every query under BM25, exactly.

    A query's repeated words count as often as they come.  Scores are rounded to six
    places; equal ones rank by doc_id; documents without a word of the query are never
    listed.  Queries of up to ``shard_bytes`` of text are broadcast together, more are
    hashed into shards of that size, searched one after the other.  Rows with a null id
    or text do not exist; each row is a document or a query of its own; an empty text
    counts among the documents but is never listed; texts of any length are read whole;
    empty tables give an empty result; other columns are ignored.  Ids may be of any type
    that can be ordered.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    queries = queries.select("item_id", "text").where("item_id is not null and text is not null")
    types = to_arrow_type(queries.schema["item_id"].dataType), to_arrow_type(docs.schema["doc_id"].dataType), pa.float64()
    shards = max(1, -(-(queries.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0) // shard_bytes))
    found = None
    for s in range(shards):
        part = queries if shards == 1 else queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == s)
        asked = part.orderBy("item_id", "text").collect()  # of shard_bytes at most
        hashed = hash_words([r["text"] for r in asked])
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashed]))
        wanted = [(r["item_id"], *np.unique(np.searchsorted(vocabulary, h), return_counts=True)) for r, h in zip(asked, hashed, strict=True)]
        table = materialise(_postings(docs, vocabulary), "postings")
        n, total = table.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).collect()[0]
        df = np.zeros(len(vocabulary))
        for r in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each word of the shard's queries
            df[r["t"]] = r["count"]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        held = sc.broadcast((wanted, idf, total / max(n, 1) or 1.0))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            wanted, idf, avg = held.value
            floor = [[0.0] * k for _ in wanted]  # the best scores so far of each query

            def block(ids: list, dls: list, sizes: list, terms: list, tfs: list) -> pa.RecordBatch:
                i, dl, size, t, tf = (np.concatenate(x) for x in (ids, dls, sizes, terms, tfs))
                norm = K1 * (1 - B + B * np.repeat(dl, size) / avg)
                impact = idf[t] * tf * (K1 + 1) / (tf + norm)
                ix = Block(i, np.concatenate(([0], np.cumsum(size))), t, impact, float(impact.max(initial=0)), len(idf))
                out: list[tuple[object, object, float]] = []
                for j, (item, q, m) in enumerate(wanted):
                    hits = ix.search(q, m, k, floor[j][-1])
                    floor[j] = sorted(floor[j] + [h[0] for h in hits], reverse=True)[:k]
                    out += [(item, d, sc) for sc, d in hits]
                cols = list(zip(*out, strict=True)) or [(), (), ()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["item_id", "doc_id", "score"])

            held_rows: list[list] = [[] for _ in range(5)]
            waiting = 0
            for b in batches:
                terms, tfs = b.column("terms"), b.column("tfs")
                for x, y in zip(held_rows, (b.column("doc_id").to_numpy(zero_copy_only=False), b.column("dl").to_numpy(), terms.value_lengths().to_numpy(), terms.flatten().to_numpy(), tfs.flatten().to_numpy()), strict=True):
                    x.append(y)
                waiting += b.num_rows
                if waiting >= BLOCK_DOCS:
                    yield block(*held_rows)
                    held_rows, waiting = [[] for _ in range(5)], 0
            if waiting:
                yield block(*held_rows)

        part = table.mapInArrow(run, f"item_id {type_of(queries, 'item_id')}, doc_id {type_of(docs, 'doc_id')}, score double")
        found = part if found is None else found.union(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def op5(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT item_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * dl / avgdl))), 6) AS score
       FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= {K}
"""
