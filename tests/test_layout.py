"""What a stored index reads: plans, pushed filters, snapshots."""

import re
import threading
import time

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillon import query as q
from quillon.index import RepeatedIds, SearchIndex
from quillon.mapping import DocumentMapping, IndexMapping, keyword_field, numeric_field, text_field, vector_field
from quillon.plans.compiler import BadPattern, compile_query, java_regex
from quillon.search import Cancelled, SearchRequest, cancel, search


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = [(i, f"common word{i % 50} rare{i}", f"k{i % 7}", float(i), [float(np.sin(i * k)) for k in range(1, 9)]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, n double, vec array<float>")
    m = IndexMapping(DocumentMapping({"text": text_field("simple"), "kind": keyword_field(), "n": numeric_field(), "vec": vector_field(8)}))
    said = []
    index = SearchIndex.of(docs, m, logger=said.append).with_cells("vec", 40)
    path = str(tmp_path_factory.mktemp("index"))
    out = index.save(path)
    assert len(said) == 2 and "3000" in said[0]
    return index, out, path


def plan(df):
    return df._jdf.queryExecution().toString()


def ids(index, node):
    return {r["doc_id"]: round(r["score"], 9) for r in compile_query(index, node).collect()}


def test_stored_equals_unstored(stored):
    index, out, _ = stored
    assert out.stats == index.stats and out.stats.docs == 3000 and out.stats.lengths["text"] == 9000
    for node in (q.Term("common", "text"), q.Match("word3 rare7 word3", "text", analyzer="simple"), q.MatchPhrase("common word5", "text", "simple"), q.Prefix("rare1", "text"), q.Fuzzy("word12", "text", 1), q.Regexp("^rare[12]5+$", "text"), q.NumericRange(5.0, 9.0, "n"), q.Term("nothing", "text")):
        assert ids(index, node) == ids(out, node)
    assert {tuple(r) for r in out.term_stats("kind").collect()} == {tuple(r) for r in index.term_stats("kind").collect()}


def test_a_term_is_looked_up_not_counted(stored):
    _, out, _ = stored
    text = plan(compile_query(out, q.Term("word3", "text")))
    assert text.split("== Physical Plan ==")[1].count("FileScan") == 1 and "Exchange" not in text.split("== Physical Plan ==")[1].replace("BroadcastExchange", "")
    assert re.search(r"PartitionFilters: \[[^\]]*field", text) and re.search(r"PushedFilters: \[[^\]]*(EqualTo|In)\(term", text)


def test_patterns_scan_the_dictionary(stored):
    _, out, _ = stored
    for node in (q.Wildcard("rare12?", "text"), q.Regexp("^word1[0-3]$", "text"), q.Fuzzy("word12", "text", 1)):
        text = plan(compile_query(out, node)).split("== Physical Plan ==")[1]
        assert text.count("FileScan") == 1 and "doc_id:bigint" in text and re.search(r"PushedFilters: \[[^\]]*(In|EqualTo|GreaterThanOrEqual)\(term", text)


def test_fields_of_a_page_reach_the_scan(stored):
    _, out, _ = stored
    got = search(out, SearchRequest(q.Term("word3", "text"), size=5, fields=("kind",)))
    text = plan(got.hits)
    assert re.search(r"PushedFilters: \[[^\]]*In\(doc_id", text) and "ReadSchema: struct<doc_id:bigint,kind:string>" in text
    assert got.hits.count() == 5 and got.status.successful == 1 and got.total == 60
    assert out.document(17)["kind"] == "k3"


def test_postings_of_a_frequent_term_are_spread(spark, tmp_path):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the the "), F.col("id").cast("string")).alias("text"))
    path = str(tmp_path / "i")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these partitions are tiny
    try:
        SearchIndex.of(docs, IndexMapping(DocumentMapping({"text": text_field("simple")}, dynamic=False))).save(path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    out = SearchIndex.open(spark, path)
    assert out.postings("text").where("term = 'the'").select(F.input_file_name()).distinct().count() > 1


def test_knn_scans_once_and_cells_prune(stored, spark):
    index, out, _ = stored
    vec = tuple(float(np.sin(77 * k)) for k in range(1, 9))
    text = plan(compile_query(out, q.KNN(vec, 10, "vec"))).split("== Physical Plan ==")[1]
    assert text.count("FileScan") == 1
    probed = plan(compile_query(out, q.KNN(vec, 10, "vec", probes=4)))
    assert re.search(r"PartitionFilters: \[[^\]]*cell", probed)
    exact = ids(out, q.KNN(vec, 10, "vec"))
    assert ids(out, q.KNN(vec, 10, "vec", probes=40)) == exact
    found = total = 0
    for i in range(0, 400, 20):
        v = tuple(float(np.sin(i * k)) + 0.01 for k in range(1, 9))
        want = set(ids(out, q.KNN(v, 10, "vec")))
        found += len(want & set(ids(out, q.KNN(v, 10, "vec", probes=12))))
        total += len(want)
    assert found >= 0.9 * total
    new = spark.createDataFrame([(9000, "common", "k", 1.0, list(vec))], "doc_id long, text string, kind string, n double, vec array<float>")
    changed = out.index(new).delete(spark.createDataFrame([(0,)], "doc_id long"))
    assert next(iter(ids(changed, q.KNN(vec, 1, "vec", probes=1)))) in (77, 9000)
    assert changed.tables["cells"].where("doc_id = 9000").count() == 1 and changed.tables["cells"].where("doc_id = 0").count() == 0
    with pytest.raises(ValueError, match="no cells"):
        compile_query(SearchIndex.of(new), q.KNN(vec, 1, "vec", probes=1))


def test_repeated_ids_are_refused(spark):
    index = SearchIndex.of(spark.createDataFrame([("a", "fox"), ("a", "dog")], "doc_id string, t string"))
    with pytest.raises(RepeatedIds):
        compile_query(index, q.Term("fox", "t"))
    ops = spark.createDataFrame([(1, "index", "a", "fox"), (2, "index", "a", "dog"), (2, "delete", "b", None)], "seq int, op string, doc_id string, t string")
    empty = SearchIndex.of(spark.createDataFrame([], "doc_id string, t string"))
    assert set(ids(empty.batch(ops), q.Term("dog", "t"))) == {"a"} and ids(empty.batch(ops), q.Term("fox", "t")) == {}


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "i")
    one = SearchIndex.of(spark.createDataFrame([("a", "fox")], "doc_id string, t string")).save(path)
    two = one.index(spark.createDataFrame([("b", "fox")], "doc_id string, t string")).save(path)
    assert one.doc_count() == 1 and set(ids(one, q.Term("fox", "t"))) == {"a"}  # a reader keeps its version
    assert two.doc_count() == 2 and set(ids(SearchIndex.open(spark, path), q.Term("fox", "t"))) == {"a", "b"}
    assert sorted(p.name for p in (tmp_path / "i").iterdir() if p.is_file() and not p.name.startswith(".")) == ["meta.json"]
    assert SearchIndex.vacuum(spark, path) == 1 and set(ids(SearchIndex.open(spark, path), q.Term("fox", "t"))) == {"a", "b"}


def test_cancellation(spark, stored):
    @F.udf("double")
    def slow(x):
        time.sleep(0.5)
        return 1.0

    class Slow(q.Query):
        def compile(self, compiler):
            return compiler.index.doc_ids().select("doc_id", slow("doc_id").alias("score"))

        def texts(self):
            return []

    threading.Timer(4, lambda: cancel(spark, "mine")).start()
    began = time.time()
    with pytest.raises(Cancelled):
        search(stored[1], SearchRequest(Slow()), tag="mine")
    assert time.time() - began < 60
    assert search(stored[1], SearchRequest(q.Term("rare7", "text")), tag="mine").total == 1


@pytest.mark.parametrize("pattern,text,found", [
    ("[a]b$", "ab\n", False), ("[a]b$", "ab", True), ("[$]x", "$x", True), ("[]a]+$", "]a", True), ("[^]a]$", "]", False), ("[[:alpha:]]+$", "abc", True), ("[[:^alpha:]]$", "1", True),
    ("(?P<n>a)b", "ab", True), (r"a\$b", "a$b", True), ("[a&&b]", "&", True), ("[[a]", "[", True), (r"\Qa.b\E$", "a.b", True), ("(?i)AB", "ab", True),
])
def test_patterns_become_java(spark, pattern, text, found):
    row = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(java_regex(spark, pattern))).collect()[0][0]
    assert row == found


@pytest.mark.parametrize("pattern", ["a++", "a*+b", "(?>a)b", "(?=a)", "(?<!a)b", r"(a)\1", r"\k<n>", "(", "(?P=n)"])
def test_patterns_refused(spark, pattern):
    with pytest.raises(BadPattern):
        java_regex(spark, pattern)


def test_limits_warn(spark):
    index = SearchIndex.of(spark.createDataFrame([Row(doc_id="a", t="fox")]))
    with pytest.warns(UserWarning, match="at most 10000 hits"):
        assert search(index, SearchRequest(q.Term("fox", "t"), size=20_000)).total == 1
