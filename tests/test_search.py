import datetime as dt
import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillon import query as q
from quillon.index import DocumentNotFound, IndexVersionError, SearchIndex
from quillon.mapping import DocumentMapping, IndexMapping, MappingError, keyword_field, numeric_field, text_field, vector_field
from quillon.operators.facets import FacetRequest, Range
from quillon.operators.scoring import bm25
from quillon.plans.compiler import BadPattern, compile_query, java_regex, normalise
from quillon.search import HighlightRequest, SearchRequest, search

DOCS = [
    Row(doc_id="a", title="Fast search engines", body="The quick brown fox jumps over lazy dogs", author="ann", rating=4.5),
    Row(doc_id="b", title="Distributed systems", body="Quick systems are brown and scalable", author="bob", rating=3.0),
    Row(doc_id="c", title="Databases", body="A fox in a database, a quick brown fox", author="ann", rating=5.0),
    Row(doc_id="d", title="Nothing here", body="lorem ipsum", author="cid", rating=1.0),
]


@pytest.fixture(scope="module")
def index(spark):
    m = IndexMapping(DocumentMapping({"author": keyword_field()}))
    return SearchIndex.of(spark.createDataFrame(DOCS), m).warm()


def ids(index, node):
    return {r["doc_id"]: r["score"] for r in compile_query(index, node).collect()}


def test_match_and_phrase(index):
    assert set(ids(index, q.Match("foxes", "body"))) == {"a", "c"}
    assert set(ids(index, q.Match("brown fox", "body"))) == {"a", "b", "c"}
    assert set(ids(index, q.Match("brown fox", "body", "and"))) == {"a", "c"}
    assert set(ids(index, q.MatchPhrase("quick brown fox", "body"))) == {"a", "c"}
    assert set(ids(index, q.MatchPhrase("brown and scalable", "body"))) == set()  # the gap of the stop word stays
    assert ids(index, q.Match("the", "body")) == {}
    assert ids(index, q.Match("quick")) == {}  # nothing is indexed under no field


def test_expansions(index):
    assert set(ids(index, q.Prefix("SYS", "title"))) == {"b"}
    assert set(ids(index, q.Fuzzy("quikc", "body", 2))) == {"a", "b", "c"}
    assert set(ids(index, q.Wildcard("f?x", "body"))) == {"a", "c"}
    assert set(ids(index, q.Regexp("^(lorem|ipsum)$", "body"))) == {"d"}
    with pytest.raises(BadPattern):
        ids(index, q.Regexp("(", "body"))
    with pytest.raises(BadPattern):
        java_regex(index.spark, r"(a)\1")


def test_booleans(index):
    fox, brown, systems = q.Term("fox", "body"), q.Term("brown", "body"), q.Term("system", "body")
    assert set(ids(index, q.Boolean((brown,), (), (systems,)))) == {"a", "c"}
    assert ids(index, q.Boolean(must_not=(brown,))) == {"d": 1.0}
    assert ids(index, q.Boolean()) == {}
    with_bonus, plain = ids(index, q.Boolean((brown,), (fox,))), ids(index, brown)
    assert with_bonus["a"] > plain["a"] and with_bonus["b"] == plain["b"]
    assert set(ids(index, q.Disjunction((fox, brown, systems), 2))) == {"a", "b", "c"}
    assert ids(index, q.Conjunction(())) == {} and ids(index, q.Disjunction(())) == {}
    assert isinstance(normalise(q.Conjunction((fox, q.MatchNone()))), q.MatchNone)


def test_boost_is_linear(index):
    one, three = ids(index, q.Term("fox", "body")), ids(index, q.Term("fox", "body").boosted(3.0))
    assert all(math.isclose(three[k], 3 * v) for k, v in one.items())


def test_bm25_identity(spark):
    got = spark.range(1).select(bm25()(F.lit(3.0), F.lit(50.0), F.lit(1.0), F.lit(100.0), F.lit(10.0), F.lit(50.0))).collect()[0][0]
    want = math.log(1 + (100 - 10 + 0.5) / (10 + 0.5)) * (3 * 2.2) / (3 + 1.2)
    assert abs(got - want) < 1e-10


def test_request(index):
    request = SearchRequest(q.Match("quick brown fox", "body"), size=2, fields=("title",), highlight=HighlightRequest(("title",)), facets={"authors": FacetRequest("author", 1), "rates": FacetRequest("rating", numeric_ranges=(Range("good", 4.0), Range("all", 0.0, 10.0)))})
    got = search(index, request)
    rows = got.hits.collect()
    assert got.total == 3 and [r["rank"] for r in rows] == [1, 2] and "author" not in rows[0]
    assert got.max_score == rows[0]["score"]
    assert got.facets["authors"].terms == [("ann", 2)] and got.facets["authors"].other == 1
    assert got.facets["rates"].ranges == [("good", 2), ("all", 3)] and got.facets["rates"].total == 5
    beyond = search(index, SearchRequest(q.MatchAll(), start=50))
    assert beyond.total == 4 and beyond.hits.count() == 0


def test_changes_and_storage(spark, index, tmp_path):
    fresh = spark.createDataFrame([Row(doc_id="a", title="new", body="unicorn", author="eve", rating=2.0), Row(doc_id="e", title="x", body="unicorn", author="eve", rating=2.0)])
    changed = index.index(fresh).delete(spark.createDataFrame([("d",), ("nobody",)], "doc_id string"))
    assert changed.doc_count() == 4
    assert set(ids(changed, q.Term("unicorn", "body"))) == {"a", "e"} and set(ids(changed, q.Term("fox", "body"))) == {"c"}
    kept = changed.save(str(tmp_path / "ix"))
    assert kept.document("e")["body"] == "unicorn" and ids(kept, q.Term("fox", "body")) == ids(changed, q.Term("fox", "body"))
    with pytest.raises(DocumentNotFound):
        kept.document("d")
    meta = tmp_path / "ix" / "meta.json"
    (tmp_path / "ix" / ".meta.json.crc").unlink(missing_ok=True)
    meta.write_text(meta.read_text().replace('"version": "2"', '"version": "9"'))
    with pytest.raises(IndexVersionError):
        SearchIndex.open(spark, str(tmp_path / "ix"))


def test_ids_and_mapping(spark):
    for bad in ("", "a/b", "x" * 513, "a\x01"):
        with pytest.raises(Exception, match="invalid document id"):
            SearchIndex.of(spark.createDataFrame([(bad, "t")], "doc_id string, t string")).doc_ids().collect()
    with pytest.raises(MappingError):
        IndexMapping(default=None).validate()
    nested = spark.createDataFrame([("1", Row(city="Bonn", geo=Row(lat=1.0)))], "doc_id string, place struct<city:string,geo:struct<lat:double>>")
    m = DocumentMapping().add_sub("place", DocumentMapping({"city": text_field("simple")}).add_sub("geo", DocumentMapping({"lat": numeric_field()})))
    ix = SearchIndex.of(nested, IndexMapping(m))
    assert set(ids(ix, q.Term("bonn", "place.city"))) == {"1"} and set(ids(ix, q.NumericRange(0, 2, "place.geo.lat"))) == {"1"}
    stamps = spark.createDataFrame([("1", "2024-05-01T00:00:00Z"), ("2", "2024")], "doc_id string, v string")
    ix = SearchIndex.of(stamps)
    assert set(ids(ix, q.DateRange(dt.datetime(2024, 1, 1), None, "v"))) == {"1"} and set(ids(ix, q.Term("2024", "v"))) == {"2"}


def test_knn_recall_is_one(spark):
    import numpy as np

    rng = np.random.default_rng(42)
    v = rng.normal(size=(200, 16)).astype(np.float32)
    ix = SearchIndex.of(spark.createDataFrame([(f"{i:03}", x.tolist()) for i, x in enumerate(v)], "doc_id string, e array<float>"), IndexMapping(DocumentMapping({"e": vector_field(16)})))
    sim = v @ v[0] / np.linalg.norm(v, axis=1) / np.linalg.norm(v[0])
    for k in (1, 5, 10, 50):
        want = {f"{i:03}" for i in np.argsort(-sim)[:k] if sim[i] > 0}
        assert set(ids(ix, q.KNN(tuple(map(float, v[0])), k, "e"))) == want


def test_plans(spark, index):
    from quillon.search import top_hits

    plan = top_hits(compile_query(index, q.Match("fox", "body")))._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "BroadcastHashJoin" in plan


def test_plugins(spark):
    docs = spark.createDataFrame(DOCS)

    class Even(q.Query):
        """A custom query: documents of an even rating."""

        def compile(self, compiler):
            return compiler.index.numbers("rating").where("value % 2 = 0").select("doc_id", F.lit(3.0).alias("score"))

    def reversed_terms(raw, f):
        return raw.select(F.reverse("value").alias("term"), "doc_id", F.lit(1).alias("tf"), F.lit(1).alias("dl"), F.lit(None).cast("array<int>").alias("positions"), F.lit(f.name).alias("field"))

    seen = []
    m = IndexMapping(DocumentMapping({"author": keyword_field(), "rating": numeric_field()}))
    ix = SearchIndex.of(docs, m, plugins={"field_indexers": {"keyword": reversed_terms}, "facet_builder": lambda index, hits, want: seen.append((want.field, hits.count())) or "mine"}, scorer=lambda tf, dl, boost, n, df, avg: tf * boost)
    assert ids(ix, q.Term("nna", "author")) == {"a": 1.0, "c": 1.0}  # own field indexer, own scorer
    assert ids(ix, Even()) == {} and ids(ix, q.Boolean((q.MatchAll(),), must_not=(Even(),))).keys() == {"a", "b", "c", "d"}
    assert search(ix, SearchRequest(q.MatchAll(), facets={"f": FacetRequest("author")})).facets == {"f": "mine"} and seen == [("author", 4)]
    with pytest.raises(TypeError):
        ids(ix, q.Query())
    q.register_query("even", lambda p: Even())
    assert ids(ix, q.named_query("even", {})) == {}


def test_facets_by_force(spark):
    from collections import Counter

    from quillon.operators import facets

    rows = [(i, f"k{i % 7}" if i % 11 else "rare" + str(i), float(i % 13), dt.datetime(2024, 1, 1 + i % 28)) for i in range(300)]
    ix = SearchIndex.of(spark.createDataFrame(rows, "doc_id long, k string, n double, t timestamp"), IndexMapping(DocumentMapping({"k": keyword_field(), "n": numeric_field()})))
    hits = compile_query(ix, q.NumericRange(3.0, 9.0, "n"))
    inside = [r for r in rows if 3 <= r[2] <= 9]
    count = Counter(r[1] for r in inside)
    best = sorted(count.items(), key=lambda x: (-x[1], x[0]))
    got = facets.build_facet(ix, hits, FacetRequest("k", 4))
    assert got.terms == best[:4] and got.total == len(inside) and got.other == len(inside) - sum(n for _, n in best[:4]) and got.missing == 0
    assert facets.build_facet(ix, hits, FacetRequest("k", 0)).terms == best
    days = (Range("early", None, dt.datetime(2024, 1, 9)), Range("all"), Range("late", dt.datetime(2024, 1, 9), None))
    got = facets.build_facet(ix, hits, FacetRequest("t", date_ranges=days))
    assert got.ranges == [("early", sum(r[3] <= dt.datetime(2024, 1, 9) for r in inside)), ("all", len(inside)), ("late", sum(r[3] >= dt.datetime(2024, 1, 9) for r in inside))]
    none = facets.build_facet(ix, ix.doc_ids().where("false"), FacetRequest("k"))
    assert none.terms == [] and none.total == 0


def test_symbols_of_a_document(spark):
    from quillon.mapping import symbol_field

    ix = SearchIndex.of(spark.createDataFrame([("a", "class A:\n  def f(self): pass\n", "python"), ("b", "fn go() {}\n", "rust")], "doc_id string, src string, _lang string"), IndexMapping(DocumentMapping({"src": symbol_field()}, dynamic=False)))
    found = ix.symbols_of("src", "a").collect()
    assert [(s["name"], s["kind"]) for s in found[0]["symbols"]] == [("A", "class"), ("f", "method")]
    assert ix.symbols_of("src", "nobody").count() == 0 and [s["language"] for s in ix.symbols_of("src", "b").collect()[0]["symbols"]] == ["rust"]
    with pytest.raises(DocumentNotFound):
        SearchIndex.of(spark.createDataFrame([("a", "x")], "doc_id string, t string")).symbols_of("t", "a")


def test_static_and_stored_fields(spark):
    rows = spark.createDataFrame([Row(doc_id="a", t="fox", u="dog", v="cat")])
    m = IndexMapping(DocumentMapping({"t": text_field("simple"), "u": keyword_field()}, dynamic=False))
    ix = SearchIndex.of(rows, m)
    assert ix.tables["docs"].columns == ["doc_id", "t", "u"] and ids(ix, q.Term("cat", "v")) == {}
    assert ids(ix, q.Term("dog", "u")).keys() == {"a"} and ix.document("a") == {"doc_id": "a", "t": "fox", "u": "dog"}
    ix.close()
