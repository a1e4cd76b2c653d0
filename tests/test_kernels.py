"""The Arrow forms of the analyzers against their Column forms, in whole batches and in small slices."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon import query as q
from quillon.functions import analysis as a
from quillon.functions import kernels
from quillon.index import SearchIndex
from quillon.mapping import DocumentMapping, IndexMapping, code_field, text_field
from quillon.plans.compiler import compile_query

CHAINS = {
    "unicode": a.chain(a.unicode_tokens), "whitespace": a.chain(a.whitespace_tokens), "keyword": a.chain(a.keyword_tokens), "simple": a.SIMPLE, "standard": a.STANDARD,
    "code": a.chain(a.code_tokens), "code_unique": a.registry.analyzer("code"), "ngrams": a.chain(a.unicode_tokens, a.ngrams(2, 3)), "edge": a.chain(a.unicode_tokens, a.edge_ngrams(2, 4)),
    "length": a.chain(a.unicode_tokens, a.length_between(2, 4)), "unique": a.chain(a.unicode_tokens, a.lowercase, a.unique), "html": a.chain(a.whitespace_tokens, before=(a.strip_html,)),
}


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(3)
    signs = "ab zAZ09_.._-\t\n\r\x0b\x1c\x85   äÄßẞıİΣσςé́中ǅ𝒜<&>'\"()"
    rows = [(i, "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40)))) for i in range(300)]
    rows += [(1000 + k, " ".join(map(chr, range(k * 100 + 1, k * 100 + 101)))) for k in range(0xD7)]
    rows += [(2000, None), (2001, ""), (2002, " "), (2003, "HTTPServer getUserName aB_cD.eF XMLHttp_Request2B éÉa x.y_z."), (2004, "ΑΣ ΣΑΣ. Σ İI")]
    out = spark.createDataFrame(rows, "id int, t string").repartition(2).persist()
    yield out
    out.unpersist()


@pytest.mark.parametrize("most", [kernels.SLICE, 64])
@pytest.mark.parametrize("name", sorted(CHAINS))
def test_kernel_equals_column(spark, texts, name, most, monkeypatch):
    monkeypatch.setattr(kernels, "SLICE", most)
    own, by_row = CHAINS[name], {r["id"]: [tuple(t) for t in r["x"] or []] for r in texts.select("id", CHAINS[name](F.col("t")).alias("x")).collect()}
    table, sign = texts.select("id", a.raw_text(F.col("t"), own).alias("t")).toArrow().combine_chunks().to_batches()[0], kernels.alphabet(spark)
    got = {i: [] for i in by_row}
    for part in kernels.slices(table, pa.compute.binary_length(table.column("t"))):
        t = own.kernel(part.column("t"), sign)
        for row, term, at in zip(part.column("id").take(pa.array(t.row)).to_pylist(), t.flat().to_pylist(), t.position.tolist(), strict=True):
            got[row].append((term, at))
    assert got == by_row


def test_slices_are_bounded():
    b = pa.RecordBatch.from_pydict({"t": ["x" * 10] * 7 + ["y" * 100, None, "z"]})
    parts = list(kernels.slices(b, pa.compute.binary_length(b.column("t")), 40))
    assert [r for p in parts for r in p.column("t").to_pylist()] == b.column("t").to_pylist() and max(p.num_rows for p in parts) <= 5


def test_wrong_utf8_is_no_letter(spark):
    bad = pa.array([b"ab\xff\xc3", b"\x80cd", b"\xf0\x9f"]).view(pa.string())
    t = a.SIMPLE.kernel(bad, kernels.alphabet(spark))
    assert list(zip(t.row.tolist(), t.flat().to_pylist(), strict=True)) == [(0, "ab"), (1, "cd")]


@pytest.mark.parametrize("field, node", [(text_field("simple"), q.Match("the fox fox", "t", "and", "simple")), (code_field(), q.Match("get", "t", analyzer="code")), (text_field("simple"), q.MatchPhrase("the fox", "t", "simple")), (text_field("simple"), q.Term("nowhere", "t"))])
def test_unsaved_index_reads_wanted_terms_only(spark, field, node, monkeypatch):
    """An index that is not kept makes the postings of a query's terms, not all; it counts statistics and frequencies in one pass."""
    docs = spark.createDataFrame([(1, "The fox saw the fox"), (2, "the dog getFox"), (3, "fox, the Fox"), (4, None), (5, "get_it the fox")], "doc_id int, t string")
    mapping = IndexMapping(DocumentMapping({"t": field}, dynamic=False))
    kept = SearchIndex.of(docs, mapping).warm()
    want = sorted(compile_query(kept, node).collect())
    fresh = SearchIndex.of(docs, mapping)
    monkeypatch.setattr(SearchIndex, "postings", lambda self, name: pytest.fail("all postings were made") if node != q.Term("nowhere", "t") else docs.where("false").selectExpr("doc_id", "t as term", "1 as tf", "1 as dl"))
    assert sorted(compile_query(fresh, node).collect()) == want and bool(want) == (node != q.Term("nowhere", "t"))
    assert fresh.stats == kept.stats
    kept.close()


def test_symbols_are_taken_in_bounded_parts(spark, monkeypatch):
    from quillon.operators import codesearch

    docs = spark.createDataFrame([(1, "def f():\n  pass\nclass A:\n  pass"), (2, None), (3, ""), (4, "x = 1")], "doc_id int, value string").coalesce(1)
    want = codesearch.symbols(docs, "python").collect()
    sizes = []
    monkeypatch.setattr(codesearch, "SLICE", 8)
    monkeypatch.setattr(codesearch, "slices", lambda b, size, most: (sizes.append(most), *kernels.slices(b, size, most))[1:])
    assert codesearch.symbols(docs, "python").collect() == want
    assert [[s["name"] for s in r["symbols"]] for r in want] == [["f", "A"], [], [], ["x"]]


def test_frequencies_shuffle_only_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "b a b"), (1, "a c"), (2, "a A"), (None, "z"), (None, "z y"), (3, None), (4, "")], "doc_id int, t string")
    want = sorted(map(repr, a.token_frequencies(docs.select("doc_id", a.SIMPLE(F.col("t")).alias("tokens"))).collect()))
    assert sorted(map(repr, a.frequencies(docs, "t", a.SIMPLE).collect())) == want
    got = {(r["doc_id"], r["term"]): (r["tf"], r["positions"]) for r in a.frequencies(docs, "t", a.SIMPLE).collect()}
    assert got[1, "a"] == (2, [1, 2]) and got[1, "b"] == (2, [1, 3]) and got[2, "a"] == (2, [1, 2]) and got[None, "z"] == (2, [1, 1]) and len(got) == 6
    for once in (a.frequencies(docs.where("doc_id > 1"), "t", a.SIMPLE), a.token_frequencies(docs.where("doc_id > 1").select("doc_id", a.SIMPLE(F.col("t")).alias("tokens")))):
        assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()


def test_offsets_by_kernel_and_by_row(spark, texts):
    for name in ("simple", "code", "html", "keyword", "unique"):
        own = CHAINS[name]
        slow = lambda text: own(text)  # noqa: E731, B023
        slow.pattern, slow.before, slow.inner = own.pattern, own.before, own.inner
        some = texts.where("id < 1000 or id >= 2000")  # by row, letters newer than the JVM's are misplaced
        want = {r["id"]: r["x"] for r in a.with_offsets(some, "t", slow, "x").collect()}
        assert {r["id"]: r["x"] for r in a.with_offsets(some, "t", own, "x").collect()} == want
        flat = sorted(tuple(r) for r in a.token_rows(some, ["id"], "t", own, offsets=True).collect())
        assert flat == sorted((i, *t) for i, x in want.items() for t in x or [])
    for r in a.with_offsets(texts, "t", a.chain(a.unicode_tokens), "x").where("t is not null").collect():
        assert [r["t"].encode()[t["start"] : t["end"]].decode() for t in r["x"]] == [t["term"] for t in r["x"]]


def test_unsaved_index_is_changed_by_documents(spark):
    """The postings of an index that is not kept are made of the documents that stay, not joined."""
    docs = spark.createDataFrame([(1, "fox one"), (2, "fox two"), (3, "dog")], "doc_id int, t string")
    new = spark.createDataFrame([(2, "dog dog"), (4, "fox")], "doc_id int, t string")
    mapping = IndexMapping(DocumentMapping({"t": text_field("simple")}, dynamic=False))
    changed = SearchIndex.of(docs, mapping).apply(new, spark.createDataFrame([(3,)], "doc_id int"))
    whole = SearchIndex.of(spark.createDataFrame([(1, "fox one"), (2, "dog dog"), (4, "fox")], "doc_id int, t string"), mapping)
    assert changed._made and changed.stats == whole.stats
    for term in ("fox", "dog", "two"):
        assert sorted(compile_query(changed, q.Term(term, "t")).collect()) == sorted(compile_query(whole, q.Term(term, "t")).collect())
    kept = SearchIndex.of(docs, mapping).warm()
    assert not kept._made and sorted(compile_query(kept.index(new), q.Term("fox", "t")).collect()) == sorted(compile_query(SearchIndex.of(docs, mapping).index(new), q.Term("fox", "t")).collect())
    kept.close()
