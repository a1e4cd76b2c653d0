"""Query trees to plans.

``normalise`` rewrites the tree (flattening, empty branches, fusing sibling terms of a
field into one scan); ``compile_query`` builds one lazy DataFrame of (doc_id, score).
Text leaves read one pruned postings scan joined to the few rows of their terms.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import query as q
from ..functions.analysis import analyze_text
from ..functions.vectors import byte_levenshtein, dot_with
from ..index import SearchIndex

MOST_TERMS, MOST_FUZZ = 1000, 2


@dataclass(frozen=True)
class Terms(q.Query):
    """Weighted terms of one field, as one scan: what sibling Term and Match queries fuse into."""

    terms: tuple[tuple[str, float], ...]
    field: str = "_all"
    boost: float = 1.0


def _flat(children: tuple[q.Query, ...], kind: type) -> list[q.Query]:
    out: list[q.Query] = []
    for c in map(normalise, children):
        nested = isinstance(c, kind) and c.boost == 1.0 and (kind is q.Conjunction or c.least <= 1)
        out += c.queries if nested else [c]
    return out


def normalise(node: q.Query) -> q.Query:
    """An equal, smaller tree: nested conjunctions and disjunctions flattened, MatchNone propagated."""
    if isinstance(node, q.Conjunction):
        kids = _flat(node.queries, q.Conjunction)
        if not kids or any(isinstance(k, q.MatchNone) for k in kids):
            return q.MatchNone()
        return replace(node, queries=tuple(kids))
    if isinstance(node, q.Disjunction):
        if node.least > 1:
            return replace(node, queries=tuple(map(normalise, node.queries)))
        kids = [k for k in _flat(node.queries, q.Disjunction) if not isinstance(k, q.MatchNone)]
        return replace(node, queries=tuple(kids)) if kids else q.MatchNone()
    if isinstance(node, q.Boolean):
        must, should, must_not = (tuple(map(normalise, c)) for c in (node.must, node.should, node.must_not))
        must_not = tuple(k for k in must_not if not isinstance(k, q.MatchNone))
        if any(isinstance(k, q.MatchNone) for k in must) or not (must or should or node.must_not):
            return q.MatchNone()
        return replace(node, must=must, should=should, must_not=must_not)
    return node


class Compiler:
    """Compiles queries against an index."""

    def __init__(self, index: SearchIndex):
        self.index, self.spark = index, index.spark

    def none(self) -> DataFrame:
        return self.index.doc_ids().where(F.lit(False)).select("doc_id", F.lit(0.0).alias("score"))

    def compile(self, node: q.Query) -> DataFrame:
        """(doc_id, score) of the matching documents, each once."""
        return self._of(normalise(node))

    def _of(self, node: q.Query) -> DataFrame:
        own = getattr(node, "compile", None)  # custom queries bring their own
        if own is not None:
            return own(self)
        make = getattr(self, "_" + type(node).__name__.lower(), None)
        if make is None:
            raise TypeError(f"cannot compile {type(node).__name__}")
        return make(node)

    # text leaves

    def _rows(self, terms: list[tuple[str, float]], dfs: dict[str, int] | None = None) -> DataFrame:
        """(term, weight, times) rows, with df where known; the weights of repeated terms add up."""
        total: dict[str, list[float]] = {}
        for t, w in terms:
            total.setdefault(t, []).append(w)
        if dfs is not None:
            return self.spark.createDataFrame([(t, float(sum(w)), len(w), float(dfs[t])) for t, w in total.items()], "term string, weight double, times int, df double")
        return self.spark.createDataFrame([(t, float(sum(w)), len(w)) for t, w in total.items()], "term string, weight double, times int")

    def literal(self, name: str, terms: list[tuple[str, float]], boost: float, need: int = 0) -> DataFrame:
        """Documents with any of the terms, or with at least ``need`` of them counting repeats."""
        if not terms:
            return self.none()
        wanted = sorted({t for t, _ in terms})
        known = self.index.dfs(name, wanted)  # first, as it may count the statistics in its pass
        stats = self.index.stats
        hits = self.index.hits(name, wanted)
        if known is None:
            df = hits.groupBy("term").agg(F.count("*").cast("double").alias("df")).join(F.broadcast(self._rows(terms)), "term")
        else:
            if not known:
                return self.none()
            df = self._rows([(t, w) for t, w in terms if t in known], known)
        length = F.when(F.coalesce("dl", F.lit(0)) == 0, 1).otherwise(F.col("dl")).cast("double")
        score = self.index.scorer(F.col("tf").cast("double"), length, F.col("weight") * float(boost), F.lit(float(stats.docs)), F.col("df"), F.lit(float(stats.avgdl(name))))
        rows = hits.join(F.broadcast(df), "term").select("doc_id", "times", score.alias("score"))
        if len(wanted) == 1 and need <= len(terms):
            return rows.select("doc_id", "score")  # one posting a document: nothing to sum
        out = rows.groupBy("doc_id").agg(F.sum("score").alias("score"), F.sum("times").alias("n"))
        return (out.where(F.col("n") >= need) if need else out).select("doc_id", "score")

    def _terms(self, n: Terms) -> DataFrame:
        return self.literal(n.field, list(n.terms), n.boost)

    def _term(self, n: q.Term) -> DataFrame:
        return self.literal(n.field, [(n.term, 1.0)], n.boost)

    def _match(self, n: q.Match) -> DataFrame:
        terms = analyze_text(self.spark, n.text, n.analyzer)
        return self.literal(n.field, [(t, 1.0) for t in terms], n.boost, need=len(terms) if n.operator == "and" else 0)

    def _matchphrase(self, n: q.MatchPhrase) -> DataFrame:
        terms = analyze_text(self.spark, n.text, n.analyzer)
        if len(terms) < 2:
            return self.literal(n.field, [(t, 1.0) for t in terms], n.boost)
        wanted = sorted(set(terms))
        known = self.index.dfs(n.field, terms[:1])
        stats = self.index.stats
        hits = self.index.hits(n.field, wanted)
        if known is None:
            first = hits.where(F.col("term") == terms[0]).agg(F.count("*").cast("double").alias("df"))
        else:
            first = self.spark.createDataFrame([(float(known.get(terms[0], 0)),)], "df double")
        spots = F.map_from_entries(F.collect_list(F.struct("term", "positions")))
        docs = hits.groupBy("doc_id").agg(spots.alias("at"), F.max(F.when(F.col("term") == terms[0], F.col("tf"))).alias("tf"), F.first("dl").alias("dl"), F.count("*").alias("n")).where(F.col("n") == len(wanted))
        rest = [F.col("at")[t] for t in terms[1:]]
        ok = F.exists(F.col("at")[terms[0]], lambda p: _all(F.array_contains(a, p + i + 1) for i, a in enumerate(rest)))
        score = self.index.scorer(F.col("tf").cast("double"), F.col("dl").cast("double"), F.lit(float(n.boost)), F.lit(float(stats.docs)), F.col("df"), F.lit(float(stats.avgdl(n.field))))
        return docs.where(ok).crossJoin(F.broadcast(first)).select("doc_id", score.alias("score"))  # one row

    # dictionary leaves

    def expanded(self, name: str, where, boost: float) -> DataFrame:
        """Documents with any of the first 1000 terms, in byte order, that satisfy ``where``.

        Terms are found in the dictionary; their postings are then read by name.
        """
        stats = self.index.stats
        found = [(r["term"], float(r["df"])) for r in self.index.term_stats(name).where(where).orderBy("term").limit(MOST_TERMS).collect()]
        if not found:
            return self.none()
        terms = self.spark.createDataFrame(found, "term string, df double")
        length = F.when(F.coalesce("dl", F.lit(0)) == 0, 1).otherwise(F.col("dl")).cast("double")
        score = self.index.scorer(F.col("tf").cast("double"), length, F.lit(float(boost)), F.lit(float(stats.docs)), F.col("df"), F.lit(float(stats.avgdl(name))))
        hits = self.index.hits(name, [t for t, _ in found]).join(F.broadcast(terms), "term")  # 1000 rows at most
        return hits.select("doc_id", score.alias("score")).groupBy("doc_id").agg(F.sum("score").alias("score"))

    def _prefix(self, n: q.Prefix) -> DataFrame:
        return self.expanded(n.field, F.col("term").startswith(n.prefix.lower()), n.boost)

    def _wildcard(self, n: q.Wildcard) -> DataFrame:
        fixed = re.split(r"[*?]", n.pattern.lower(), maxsplit=1)[0]
        return self.expanded(n.field, F.col("term").startswith(fixed) & F.col("term").rlike(q.wildcard_regex(n.pattern)), n.boost)

    def _regexp(self, n: q.Regexp) -> DataFrame:
        return self.expanded(n.field, F.col("term").rlike(java_regex(self.spark, n.pattern)), n.boost)

    def _fuzzy(self, n: q.Fuzzy) -> DataFrame:
        term = next(iter(analyze_text(self.spark, n.term, "standard")), n.term.lower())
        most = max(0, min(MOST_FUZZ, n.fuzziness))
        size = F.octet_length("term")
        near = (F.abs(size - len(term.encode())) <= most) & (byte_levenshtein(F.col("term"), F.lit(term), most) >= 0)
        return self.expanded(n.field, near, n.boost)

    def _synonym(self, n: q.Synonym) -> DataFrame:
        terms = [(t, 1.0) for t in analyze_text(self.spark, n.text, n.analyzer)]
        extra = []
        for t, _ in terms:
            for s in n.thesaurus.get(t.lower(), ())[: n.limit]:
                extra += [(x, n.synonym_boost) for x in analyze_text(self.spark, s, n.analyzer)]
        return self.literal(n.field, terms + extra, n.boost)

    # value leaves

    def _numericrange(self, n: q.NumericRange) -> DataFrame:
        return self._between(self.index.numbers(n.field), n)

    def _daterange(self, n: q.DateRange) -> DataFrame:
        return self._between(self.index.dates(n.field), n)

    def _between(self, values: DataFrame, n) -> DataFrame:
        if n.low is not None:
            values = values.where(F.col("value") >= F.lit(n.low))
        if n.high is not None:
            values = values.where(F.col("value") <= F.lit(n.high))
        return values.select("doc_id", F.lit(float(n.boost)).alias("score"))

    def _matchall(self, n: q.MatchAll) -> DataFrame:
        return self.index.doc_ids().select("doc_id", F.lit(float(n.boost)).alias("score"))

    def _matchnone(self, n: q.MatchNone) -> DataFrame:
        return self.none()

    def _knn(self, n: q.KNN) -> DataFrame:
        size = sum(x * x for x in n.vector) ** 0.5
        k = n.k if n.k > 0 else 10
        rows = self.index.nearest_cells(n) if n.probes else self.index.vectors(n.field)
        rows = rows.where((F.size("vec") == len(n.vector)) & (F.col("norm") > 0))
        near = rows.select("doc_id", (dot_with(F.col("vec"), n.vector) / (F.col("norm") * size)).alias("s")) if size else rows.select("doc_id", F.lit(0.0).alias("s"))
        top = near.where("s > 0").orderBy(F.desc(F.round("s", 9)), "doc_id").limit(k)
        best = F.max("s").over(Window.partitionBy(F.lit(1)))  # of k rows
        return top.select("doc_id", (F.col("s") / best * n.boost).alias("score"))

    # combinators

    def _merged(self, children: tuple[q.Query, ...]) -> DataFrame:
        """Σ score and number of children of each document: one shuffle, whatever the number of children."""
        out = None
        for c in children:
            part = self._of(c)
            out = part if out is None else out.unionByName(part)
        return out.groupBy("doc_id").agg(F.sum("score").alias("score"), F.count("*").alias("n"))

    def _conjunction(self, n: q.Conjunction) -> DataFrame:
        return self._merged(n.queries).where(F.col("n") == len(n.queries)).select("doc_id", (F.col("score") * n.boost).alias("score"))

    def _disjunction(self, n: q.Disjunction) -> DataFrame:
        if not n.queries:
            return self.none()
        rows = self._merged(n.queries) if n.least > 1 else self._merged(fuse(self.spark, n.queries))
        return rows.where(F.col("n") >= (n.least if n.least > 1 else 1)).select("doc_id", (F.col("score") * n.boost).alias("score"))

    def _boolean(self, n: q.Boolean) -> DataFrame:
        if n.must:
            rows = self._conjunction(q.Conjunction(n.must))
            if n.should:
                extra = self._disjunction(q.Disjunction(n.should)).withColumnRenamed("score", "more")
                rows = rows.join(extra, "doc_id", "left").select("doc_id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
        elif n.should:
            rows = self._disjunction(q.Disjunction(n.should))
        else:
            rows = self._matchall(q.MatchAll())
        if n.must_not:
            rows = rows.join(self._disjunction(q.Disjunction(n.must_not)).select("doc_id"), "doc_id", "left_anti")
        return rows.select("doc_id", (F.col("score") * n.boost).alias("score"))


def fuse(spark, children: tuple[q.Query, ...]) -> tuple[q.Query, ...]:
    """Sibling Term and any-term Match queries of one field become one scan with weights."""
    groups: dict[str, list[tuple[str, float]]] = {}
    rest: list[q.Query] = []
    for c in children:
        if isinstance(c, q.Term):
            groups.setdefault(c.field, []).append((c.term, c.boost))
        elif isinstance(c, q.Match) and c.operator != "and":
            groups.setdefault(c.field, []).extend((t, c.boost) for t in analyze_text(spark, c.text, c.analyzer))
        else:
            rest.append(c)
    return (*(Terms(tuple(t), f) for f, t in groups.items()), *rest)


def _all(conditions):
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


class BadPattern(ValueError):
    """A regular expression that is not valid."""


_POSIX = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "punct": "Punct", "space": "Space", "blank": "Blank", "cntrl": "Cntrl", "graph": "Graph", "print": "Print", "xdigit": "XDigit"}
_PART = re.compile(r"\\Q.*?(?:\\E|\Z)|\\.|\[:\^?\w+:\]|\(\?P?<?[=!]?|[*+?}]\+|.", re.S)


def java_regex(spark, pattern: str) -> str:
    """A linear-time-engine pattern for Java: named groups, POSIX classes and the end of the text translated; lookaround, backreferences, atomic groups and possessive repeats refused."""
    out, inside, first = [], False, 0
    for m in _PART.finditer(pattern):
        t = m.group()
        if t.startswith("\\"):
            if not inside and re.fullmatch(r"\\[1-9kG]", t):
                raise BadPattern(f"no backreference: {pattern!r}")
            out.append({"\\z": "\\z", "\\Z": None, "\\C": None}.get(t, t))
        elif inside:
            name = _POSIX.get(t.strip("[:^]")) if t.startswith("[:") else None
            if name:
                out.append(rf"\{'P' if '^' in t else 'p'}{{{name}}}")
            elif t == "]" and m.start() > first:
                inside = False
                out.append(t)
            else:
                out.append("\\" + t if t in "[]&" else t)
        elif t == "[":
            inside, first = True, m.end() + int(pattern[m.end() : m.end() + 1] == "^")  # a ] that comes first is a sign like others
            out.append(t)
        elif t.startswith("(?"):
            if t[-1] in "=!" or pattern[m.end() : m.end() + 1] == ">":
                raise BadPattern(f"no lookaround or atomic group: {pattern!r}")
            out.append(t.replace("P<", "<"))
        elif len(t) == 2 and t[1] == "+":
            raise BadPattern(f"no possessive repeat: {pattern!r}")
        else:
            out.append(r"\z" if t == "$" else t)
    if None in out:
        raise BadPattern(f"not supported: {pattern!r}")
    java = "".join(out)
    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
    except Exception as e:
        raise BadPattern(f"not a regular expression: {pattern!r}") from e
    return java


def compile_query(index: SearchIndex, node: q.Query) -> DataFrame:
    return Compiler(index).compile(node)
