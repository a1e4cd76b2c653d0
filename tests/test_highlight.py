import html
import re

import pytest
from pyspark.sql import functions as F

from quillon import query as q
from quillon.catalog import QUERIES
from quillon.functions import analysis as a
from quillon.index import SearchIndex
from quillon.mapping import DocumentMapping, IndexMapping, text_field
from quillon.operators.highlight import ANSI, Style, fragments, highlight, occurrences, spots
from quillon.search import HighlightRequest, SearchRequest, search


@pytest.fixture
def registry():
    yield a.registry
    a.registry.reset()


def show(spark, text, terms, analyzer="standard", style=None):
    return spark.createDataFrame([(text,)], "t string").transform(lambda d: highlight(d, "t", terms, analyzer, style or Style("[", "]"), "h")).collect()[0]["h"]


def test_fragments_escape_and_cut():
    text = "<b>Tür</b> & the fox " + "x" * 200 + " fox"
    got = fragments(text, spots(text, [5, 7], a.UNICODE), Style("[", "]"))
    assert got[0].startswith("&lt;b&gt;Tür&lt;/b&gt; &amp; the [fox]") and got[0].endswith("...") and got[1].startswith("...")
    assert fragments("a 'q' \"r\" fox", [(10, 13)], Style("[", "]")) == ["a &#39;q&#39; &#34;r&#34; [fox]"]


@pytest.mark.parametrize("analyzer,text,terms,want", [
    ("standard", "Foxes run fast", ["fox"], ["[Foxes] run fast"]),
    ("simple", "Foxes run fast", ["run"], ["Foxes [run] fast"]),
    ("whitespace", "a b-c d", ["b-c"], ["a [b-c] d"]),
    ("keyword", "whole text", ["whole text"], ["[whole text]"]),
    ("code", "x = getUserName()", ["user"], ["x = [getUserName]()"]),
    ("simple", "日本 fox 日本", ["日本"], ["[日本] fox [日本]"]),
    ("simple", "nothing", ["fox"], []),
    ("simple", "", ["fox"], []),
    ("simple", None, ["fox"], []),
    ("simple", "fox", [], []),
])
def test_analyzers(spark, analyzer, text, terms, want):
    assert show(spark, text, terms, analyzer) == want


def test_custom_analyzers(spark, registry):
    registry.set("analyzer", "grams", a.chain(a.unicode_tokens, a.lowercase, a.edge_ngrams(2, 3)))
    assert show(spark, "Foxes run", ["fox"], "grams") == ["[Foxes] run"]
    registry.set("analyzer", "web", a.chain(a.unicode_tokens, a.lowercase, before=(a.strip_html,)))
    assert show(spark, "<p>A <b>fox</b></p>", ["fox"], "web") == [" A  [fox]  "]
    registry.set("analyzer", "odd", lambda t: a.number(F.transform(F.split(t, ","), F.lower)))  # no pattern: terms as they stand
    assert show(spark, "Red fox,Blue", ["red fox"], "odd") == ["[Red fox],Blue"]
    assert occurrences("aa aaa", ["aa", "aaa"]) == [(0, 2), (3, 5)] or occurrences("aa aaa", ["aaa", "aa"]) == [(0, 2), (3, 6)]


def test_a_request_highlights_by_the_field(spark, registry):
    registry.set("analyzer", "grams", a.chain(a.unicode_tokens, a.lowercase, a.edge_ngrams(3, 3)))
    docs = spark.createDataFrame([("x", "Foxes run", "the fox")], "doc_id string, t string, u string")
    index = SearchIndex.of(docs, IndexMapping(DocumentMapping({"t": text_field("grams"), "u": text_field("simple")})))
    row = search(index, SearchRequest(q.Term("fox", "t"), highlight=HighlightRequest(style=ANSI))).hits.collect()[0]
    assert row["highlight_t"] == ["\033[1;33mFoxes\033[0m run"] and row["highlight_u"] == ["the \033[1;33mfox\033[0m"]
    index.plugins["highlighter"] = lambda col, terms, analyzer: F.array(F.concat(col, F.lit("!" + ",".join(terms) + analyzer)))
    assert search(index, SearchRequest(q.Term("fox", "t"), highlight=HighlightRequest(("t", "nowhere")))).hits.collect()[0]["highlight_t"][0].startswith("Foxes run!")


def test_offsets(spark):
    rows = a.with_offsets(spark.createDataFrame([("Tür foxes & the dogs",), ("",), (None,)], "t string"), "t", a.registry.analyzer("standard"), "x").collect()
    assert [tuple(t) for t in rows[0]["x"]] == [("tür", 1, 0, 4), ("fox", 2, 5, 10), ("dog", 4, 17, 21)]
    assert rows[1]["x"] == [] and rows[2]["x"] is None
    tokens = a.with_offsets(spark.createDataFrame([(1, "fox the fox")], "doc_id int, t string"), "t", a.registry.analyzer("simple"))
    got = {r["term"]: (r["tf"], r["positions"], r["starts"], r["ends"]) for r in a.token_frequencies(tokens).collect()}
    assert got == {"fox": (2, [1, 3], [0, 8], [3, 11]), "the": (1, [2], [4], [7])}


def test_long_texts_are_cut_at_ten_megabytes(spark):
    n = spark.range(1).select(F.size(a.registry.analyzer("simple")(F.repeat(F.lit("abcd efgh "), 1_100_000))).alias("n")).collect()[0]["n"]
    assert n == 2 * (a.MAX_BYTES // 10)


def test_query_by_force(spark):
    """The page's fragments, rebuilt from the texts one match at a time."""
    folder = "/root/testdata/sf0.001"
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["highlight"](spark, folder).collect()
    assert len(rows) == 10
    for r in rows:
        raw = text[r["doc_id"]].encode()
        left = [(len(text[r["doc_id"]][: m.start()].encode()), len(text[r["doc_id"]][: m.end()].encode())) for m in re.finditer(r"[^\W_]+", text[r["doc_id"]]) if m.group().lower() in ("the", "orantion")]
        want = []
        while left:
            lo, hi = max(0, left[0][0] - 50), min(len(raw), left[0][0] + 50)
            while lo and raw[lo] & 0xC0 == 0x80:
                lo += 1
            while hi < len(raw) and raw[hi] & 0xC0 == 0x80:
                hi += 1
            mine = [x for x in left if lo <= x[0] and x[1] <= hi] or left[:1]
            left = [x for x in left if x not in mine]
            out, at = "..." if lo else "", lo
            for b, e in mine:
                out += html.escape(raw[at:b].decode(errors="ignore")).replace("&#x27;", "&#39;").replace("&quot;", "&#34;") + "<mark>" + raw[b:e].decode() + "</mark>"
                at = e
            out += html.escape(raw[at:hi].decode(errors="ignore")).replace("&#x27;", "&#39;").replace("&quot;", "&#34;") + ("..." if hi < len(raw) else "")
            want.append(out)
        assert r["fragments"] == want
