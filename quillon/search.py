"""Search requests: top hits with stored fields, highlights and facets."""

from __future__ import annotations

import time
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import query as q
from .functions.analysis import analyze_text
from .index import SearchIndex
from .operators.facets import FacetRequest, FacetResult, build_facet
from .operators.highlight import HTML, Style, highlight
from .plans.compiler import compile_query

#: A page is collected, so it and its offset are bounded.
DEFAULT_SIZE, MOST_SIZE, MOST_FROM = 10, 10_000, 100_000


@dataclass(frozen=True)
class HighlightRequest:
    fields: tuple[str, ...] = ()
    style: Style = HTML


@dataclass(frozen=True)
class SearchRequest:
    """``fields``: None for all stored ones, empty for none."""

    query: q.Query
    size: int = DEFAULT_SIZE
    start: int = 0
    fields: tuple[str, ...] | None = None
    highlight: HighlightRequest | None = None
    facets: dict[str, FacetRequest] = field(default_factory=dict)

    @property
    def page(self) -> tuple[int, int]:
        """Offset and size within their limits; a warning where that changes the request."""
        if self.size > MOST_SIZE or self.start > MOST_FROM:
            warnings.warn(f"a page has at most {MOST_SIZE} hits and begins at most at {MOST_FROM}; top_hits has no such limits", stacklevel=3)
        return min(max(0, self.start), MOST_FROM), min(self.size if self.size > 0 else DEFAULT_SIZE, MOST_SIZE)


@dataclass(frozen=True)
class Status:
    """Parts that a request was run over: one index, whole or not at all."""

    total: int = 1
    failed: int = 0
    successful: int = 1


@dataclass
class SearchResult:
    request: SearchRequest
    hits: DataFrame  # rank, doc_id, score, stored fields, highlight_<field>
    total: int
    max_score: float
    facets: dict[str, FacetResult]
    took: float
    status: Status = Status()


class Cancelled(RuntimeError):
    """The request was cancelled while it ran."""


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop the jobs of every running request with this tag; each raises ``Cancelled``."""
    spark.sparkContext.cancelJobsWithTag(tag)


def top_hits(scored: DataFrame, start: int = 0, size: int = DEFAULT_SIZE) -> DataFrame:
    """(doc_id, score) of a page: scores rounded to six places, best first, ties by id."""
    rounded = scored.select("doc_id", F.round("score", 6).alias("score"))
    return rounded.orderBy(F.desc("score"), "doc_id").offset(start).limit(size)


def total_and_max(scored: DataFrame) -> DataFrame:
    """One row: total, max_score, over all the hits."""
    return scored.agg(F.count("*").alias("total"), F.round(F.greatest(F.lit(0.0), F.coalesce(F.max("score"), F.lit(0.0))), 6).alias("max_score"))


def stored(index: SearchIndex, page: DataFrame, fields: tuple[str, ...] | None, ids: list | None = None) -> DataFrame:
    """A page of hits with stored fields; unknown ones are ignored.  Known ``ids`` reach the scan, and of a stored index only their row groups are read."""
    docs = index.tables["docs"]
    if ids is not None:
        docs = docs.where(F.col("doc_id").isin(ids))
    names = [c for c in docs.columns if c != "doc_id" and (fields is None or c in fields)]
    return docs.select("doc_id", *names).join(F.broadcast(page), "doc_id")  # a page: MOST_SIZE rows at most


def with_highlights(index: SearchIndex, rows: DataFrame, query: q.Query, want: HighlightRequest) -> DataFrame:
    """Rows with an array of fragments for each field; without fields asked for, of every string field."""
    texts = query.texts()
    names = want.fields or tuple(n for n, t in rows.dtypes if t == "string" and n != "doc_id")
    make = index.plugins.get("highlighter")
    for name in names:
        if name not in rows.columns:
            continue
        analyzer = index.mapping.analyzer_of(name)
        terms = [t for x in texts for t in analyze_text(index.spark, x, analyzer)]
        out = f"highlight_{name}"
        rows = rows.withColumn(out, make(F.col(name), terms, analyzer)) if make else highlight(rows, name, terms, analyzer, want.style, out)
    return rows


def search(index: SearchIndex, request: SearchRequest | q.Query, tag: str | None = None) -> SearchResult:
    """Run a request.  The scored hits are computed once, for page, totals and facets.  With a ``tag`` it can be cancelled from another thread."""
    began = time.time()
    if isinstance(request, q.Query):
        request = SearchRequest(request)
    sc = index.spark.sparkContext
    if tag:
        sc.addJobTag(tag)
    try:
        out = _run(index, request)
    except Exception as e:
        if tag and "cancelled" in str(e).lower():
            raise Cancelled(tag) from e
        raise
    finally:
        if tag:
            sc.removeJobTag(tag)
    out.took = time.time() - began
    index.log(f"{type(request.query).__name__}: {out.total} hits in {out.took:.3f} s")
    return out


def _run(index: SearchIndex, request: SearchRequest) -> SearchResult:
    start, size = request.page
    scored = compile_query(index, request.query).persist()
    try:
        total, best = total_and_max(scored).collect()[0]
        page = top_hits(scored, start, size)
        rows = page.collect()  # MOST_SIZE at most
        schema = f"doc_id {scored.schema['doc_id'].dataType.simpleString()}, score double, rank int"
        page = index.spark.createDataFrame([(r["doc_id"], r["score"], start + i + 1) for i, r in enumerate(rows)], schema)
        hits = stored(index, page, request.fields, [r["doc_id"] for r in rows])
        if request.highlight:
            hits = with_highlights(index, hits, request.query, request.highlight)
        build = index.plugins.get("facet_builder", build_facet)
        facets = {name: build(index, scored, f) for name, f in request.facets.items()}
    finally:
        scored.unpersist()
    return SearchResult(request, hits.orderBy("rank"), total, best, facets, 0.0)
