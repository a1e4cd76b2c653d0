"""Facets over a hit set: counts of terms, numeric ranges and date ranges."""

from __future__ import annotations

import datetime as dt
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms of one facet that are collected; those beyond count as ``other``, with a warning.  ``term_counts`` has them all.
MOST_TERMS = 100_000


@dataclass(frozen=True)
class Range:
    """A named range, both ends included; None is open."""

    name: str
    low: float | dt.datetime | None = None
    high: float | dt.datetime | None = None


@dataclass(frozen=True)
class FacetRequest:
    """Numeric ranges go before date ranges, and those before terms."""

    field: str
    size: int = 10
    numeric_ranges: tuple[Range, ...] = ()
    date_ranges: tuple[Range, ...] = ()


@dataclass
class FacetResult:
    field: str
    total: int = 0
    other: int = 0
    missing: int = 0
    terms: list[tuple[str, int]] = field(default_factory=list)
    ranges: list[tuple[str, int]] = field(default_factory=list)


def term_counts(postings: DataFrame, hits: DataFrame) -> DataFrame:
    """(term, count) over the hits: each term of the field once for a document."""
    return postings.select("doc_id", "term").join(hits.select("doc_id"), "doc_id", "left_semi").groupBy("term").agg(F.count("*").alias("count"))


def top_terms(counts: DataFrame, size: int) -> DataFrame:
    """The greatest counts, ties by term; all for a size of 0 or less."""
    ordered = counts.orderBy(F.desc("count"), "term")
    return ordered.limit(size) if size > 0 else ordered


def range_counts(values: DataFrame, hits: DataFrame, ranges: tuple[Range, ...]) -> DataFrame:
    """(name, count) of each range over (doc_id, value) rows of the hits, in one pass; ranges may overlap."""

    def inside(r: Range) -> Column:
        ok = F.col("value").isNotNull()
        if r.low is not None:
            ok &= F.col("value") >= F.lit(r.low)
        return ok & (F.col("value") <= F.lit(r.high)) if r.high is not None else ok

    rows = values.select("doc_id", "value").join(hits.select("doc_id"), "doc_id", "left_semi")
    one = rows.agg(*(F.count_if(inside(r)).alias(f"c{i}") for i, r in enumerate(ranges)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(r.name).alias("name"), F.col(f"c{i}").alias("count")) for i, r in enumerate(ranges)))).alias("r")).select("r.*")


def build_facet(index, hits: DataFrame, want: FacetRequest) -> FacetResult:
    """One facet of a hit set."""
    out = FacetResult(want.field)
    ranges = want.numeric_ranges or want.date_ranges
    if ranges:
        values = index.numbers(want.field) if want.numeric_ranges else index.dates(want.field)
        found = {r["name"]: r["count"] for r in range_counts(values, hits, ranges).collect()}
        out.ranges = [(r.name, found[r.name]) for r in ranges]
        out.total = sum(n for _, n in out.ranges)
        return out
    counts = term_counts(index.postings(want.field), hits).persist()
    try:
        out.total, n = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).collect()[0]
        size = want.size if want.size > 0 else n
        if min(size, n) > MOST_TERMS:
            warnings.warn(f"a facet lists at most {MOST_TERMS} of the {n} terms of {want.field!r}", stacklevel=3)
        out.terms = [(r["term"], r["count"]) for r in top_terms(counts, max(1, min(size, MOST_TERMS))).collect()]
    finally:
        counts.unpersist()
    out.other = out.total - sum(n for _, n in out.terms)
    return out
