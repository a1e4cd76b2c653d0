"""Highlighting: fragments of a text around the terms of a query.

The field's own analyzer, whichever it is, tells at which positions it makes one of the
terms, and its tokenizer where those positions lie in the text.  Offsets are bytes of the
UTF-8 text; fragment ends move to the next character boundary.  Only the rows of a result
page are highlighted.
"""

from __future__ import annotations

import html
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import analysis
from ..functions.analysis import raw_spans


@dataclass(frozen=True)
class Style:
    """Tags around a match, and the width of a fragment in bytes."""

    pre: str = "<mark>"
    post: str = "</mark>"
    width: int = 100


HTML, ANSI = Style(), Style("\033[1;33m", "\033[0m")


def fragments(text: str, found: list[tuple[int, int]], style: Style = HTML) -> list[str]:
    """Fragments, each around the first match that no fragment before it holds."""
    raw = text.encode("utf-8", "surrogatepass")
    show = lambda a, b: html.escape(raw[a:b].decode("utf-8", "ignore"), quote=True).replace("&#x27;", "&#39;").replace("&quot;", "&#34;")
    left, out = sorted(found), []
    while left:
        mid = left[0][0]
        lo, hi = max(0, mid - style.width // 2), min(len(raw), mid + style.width // 2)
        while 0 < lo < len(raw) and raw[lo] & 0xC0 == 0x80:
            lo += 1
        while 0 < hi < len(raw) and raw[hi] & 0xC0 == 0x80:
            hi += 1
        inside = [s for s in left if s[0] >= lo and s[1] <= hi] or left[:1]
        parts, at = ["..."] if lo > 0 else [], lo
        for a, b in inside:
            parts += [show(at, a) if a > at else "", style.pre, show(a, b), style.post]
            at = b
        parts += [show(at, hi) if at < hi else "", "..." if hi < len(raw) else ""]
        out.append("".join(parts))
        left = [s for s in left if s not in inside]
    return out


def spots(text: str, positions: list[int], pattern: str) -> list[tuple[int, int]]:
    """Byte ranges of the raw tokens at some positions, each once."""
    spans = raw_spans(text, pattern)
    return [spans[p - 1] for p in sorted(set(positions)) if 0 < p <= len(spans)]


def highlight(df: DataFrame, column: str, terms: list[str], analyzer: str = "standard", style: Style = HTML, out: str = "fragments") -> DataFrame:
    """``df`` with array<string>: the highlighted fragments of a column; empty where nothing is found.

    The fragments are of the text as the analyzer's character filters leave it.  With a
    tokenizer that has no ``pattern``, whole terms are looked for in the text as they are.
    """
    own, text = analysis.registry.analyzer(analyzer), F.col(column)
    for f in getattr(own, "before", ()):
        text = f(text)
    tokens = getattr(own, "inner", own)(text)
    places = F.filter(tokens, lambda t: t["term"].isin(terms))["position"] if terms else F.array().cast("array<int>")
    pattern, wanted = getattr(own, "pattern", None), sorted(set(terms), key=len, reverse=True)

    def one(t: str | None, places: list[int] | None) -> list[str]:
        if not t or not places:
            return []
        return fragments(t, spots(t, places, pattern) if pattern else occurrences(t, wanted), style)

    return analysis.added(df, {"text": text, "places": places}, out, "array<string>", one)


def occurrences(text: str, terms: list[str]) -> list[tuple[int, int]]:
    """Byte ranges where terms stand in a text, in any case; the longest of those that overlap."""
    low, out, taken = text.lower(), [], set()
    for t in terms:
        at = low.find(t) if t else -1
        while at >= 0:
            if not taken & set(range(at, at + len(t))):
                taken |= set(range(at, at + len(t)))
                size = lambda s: len(s.encode("utf-8", "surrogatepass"))
                out.append((size(text[:at]), size(text[: at + len(t)])))
            at = low.find(t, at + 1)
    return sorted(out)


Highlighter = Callable[[Column, list[str], str], Column]
