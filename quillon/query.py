"""Query trees.  ``quillon.plans.compiler`` turns them into DataFrames of doc_id and score."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any


@dataclass(frozen=True)
class Query:
    """The base of all queries."""

    def boosted(self, boost: float) -> Query:
        return replace(self, boost=boost)  # type: ignore[call-arg]

    def on(self, name: str) -> Query:
        return replace(self, field=name)  # type: ignore[call-arg]

    def texts(self) -> list[str]:
        """What a highlighter should look for."""
        return []


@dataclass(frozen=True)
class Term(Query):
    """Documents holding exactly this indexed term."""

    term: str
    field: str = "_all"
    boost: float = 1.0

    def texts(self) -> list[str]:
        return [self.term]


@dataclass(frozen=True)
class Match(Query):
    """Documents holding any (``or``) or every (``and``) term of an analyzed text."""

    text: str
    field: str = "_all"
    operator: str = "or"
    analyzer: str = "standard"
    boost: float = 1.0

    def texts(self) -> list[str]:
        return [self.text]


@dataclass(frozen=True)
class MatchPhrase(Query):
    """Documents with the analyzed terms at consecutive positions."""

    text: str
    field: str = "_all"
    analyzer: str = "standard"
    boost: float = 1.0

    def texts(self) -> list[str]:
        return [self.text]


@dataclass(frozen=True)
class Prefix(Query):
    prefix: str
    field: str = "_all"
    boost: float = 1.0

    def texts(self) -> list[str]:
        return [self.prefix]


@dataclass(frozen=True)
class Fuzzy(Query):
    """Terms within ``fuzziness`` (at most 2) byte edits."""

    term: str
    field: str = "_all"
    fuzziness: int = 1
    boost: float = 1.0

    def texts(self) -> list[str]:
        return [self.term]


@dataclass(frozen=True)
class Wildcard(Query):
    """``*`` for any characters, ``?`` for one; the whole term."""

    pattern: str
    field: str = "_all"
    boost: float = 1.0


@dataclass(frozen=True)
class Regexp(Query):
    """Terms in which the pattern is found anywhere."""

    pattern: str
    field: str = "_all"
    boost: float = 1.0


@dataclass(frozen=True)
class NumericRange(Query):
    """Values from ``low`` to ``high``, both included; None is open."""

    low: float | None = None
    high: float | None = None
    field: str = "_all"
    boost: float = 1.0


@dataclass(frozen=True)
class DateRange(Query):
    low: dt.datetime | None = None
    high: dt.datetime | None = None
    field: str = "_all"
    boost: float = 1.0


@dataclass(frozen=True)
class MatchAll(Query):
    boost: float = 1.0


@dataclass(frozen=True)
class MatchNone(Query):
    boost: float = 1.0


@dataclass(frozen=True)
class KNN(Query):
    """The k most similar vectors of positive cosine, scored relative to the best.

    ``probes`` 0 scans all vectors; else only so many cells of an index with cells are read.
    """

    vector: tuple[float, ...]
    k: int = 10
    field: str = "_all"
    boost: float = 1.0
    probes: int = 0


@dataclass(frozen=True)
class Conjunction(Query):
    """Every child matches; scores add up."""

    queries: tuple[Query, ...] = ()
    boost: float = 1.0

    def texts(self) -> list[str]:
        return [t for q in self.queries for t in q.texts()]


@dataclass(frozen=True)
class Disjunction(Query):
    """At least ``least`` children match; scores add up."""

    queries: tuple[Query, ...] = ()
    least: int = 1
    boost: float = 1.0

    def texts(self) -> list[str]:
        return [t for q in self.queries for t in q.texts()]


@dataclass(frozen=True)
class Boolean(Query):
    """All of must, none of must_not; should adds score, and is needed where there is no must."""

    must: tuple[Query, ...] = ()
    should: tuple[Query, ...] = ()
    must_not: tuple[Query, ...] = ()
    boost: float = 1.0

    def texts(self) -> list[str]:
        return [t for q in (*self.must, *self.should) for t in q.texts()]


@dataclass(frozen=True)
class Synonym(Query):
    """Each analyzed term, or with less weight its synonyms."""

    text: str
    thesaurus: dict[str, tuple[str, ...]] = field(default_factory=dict, hash=False)
    field: str = "_all"
    analyzer: str = "standard"
    boost: float = 1.0
    synonym_boost: float = 0.5
    limit: int = 10

    def texts(self) -> list[str]:
        return [self.text, *(s for w in self.text.lower().split() for s in self.thesaurus.get(w, ())[: self.limit])]


class UnknownQuery(KeyError):
    """No query is registered under the name."""


_named: dict[str, Callable[[dict[str, Any]], Query]] = {}


def register_query(name: str, make: Callable[[dict[str, Any]], Query]) -> None:
    """Make a query available by name, built from a dict of parameters."""
    _named[name] = make


def named_query(name: str, params: dict[str, Any]) -> Query:
    if name not in _named:
        raise UnknownQuery(name)
    return _named[name](params)


register_query("synonym", lambda p: Synonym(**p))


def wildcard_regex(pattern: str) -> str:
    """The anchored regular expression of a wildcard pattern, in lower case."""
    out = "".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in r"\.+()[]{}^$|" else c) for c in pattern.lower())
    return rf"(?s)\A{out}\z"
