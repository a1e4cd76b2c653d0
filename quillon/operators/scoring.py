"""Scorers: Column functions of term frequency, field length, boost and collection statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (tf, dl, boost, N, n, avgdl) -> score
Scorer = Callable[[Column, Column, Column, Column, Column, Column], Column]


def bm25(k1: float = 1.2, b: float = 0.75) -> Scorer:
    def score(tf: Column, dl: Column, boost: Column, total: Column, n: Column, avgdl: Column) -> Column:
        avg = F.when(avgdl == 0, 1.0).otherwise(avgdl)
        idf = F.log(1 + (total - n + 0.5) / (n + 0.5))
        return idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b) + k1 * b / avg * dl) * boost

    return score


def tfidf() -> Scorer:
    def score(tf: Column, dl: Column, boost: Column, total: Column, n: Column, avgdl: Column) -> Column:
        idf = F.when(n > 0, F.log(total / n)).otherwise(0.0)
        return F.log(1 + tf) * idf / F.sqrt(dl) * boost

    return score
