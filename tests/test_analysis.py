import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import analysis as a
from quillon.functions.stemmer import stem
from quillon.operators.synonyms import synonym_analyzer

STEMS = "running:run caresses:caress flies:fli happiness:happi hopeful:hop relational:rel conditional:condit agreed:agre feed:feed falling:fal happy:happi sky:sky ties:tie ponies:poni"


@pytest.mark.parametrize("pair", STEMS.split())
def test_stem(pair):
    word, want = pair.split(":")
    assert stem(word) == want


@given(st.text(max_size=30))
def test_stem_never_fails_or_grows_much(word):
    assert len(stem(word)) <= len(word) + 1


def run(spark, analyzer, text):
    row = spark.createDataFrame([(text,)], "t string").select(analyzer(F.col("t")).alias("x")).collect()[0][0]
    return [(t["term"], t["position"]) for t in row]


def test_standard_keeps_gaps_of_stop_words(spark):
    assert run(spark, a.registry.analyzer("standard"), "The quick and brown foxes") == [("quick", 2), ("brown", 4), ("fox", 5)]


def test_code_tokens(spark):
    assert run(spark, a.code_tokens, "getUserName(user_id)") == [("getusername", 1), ("get", 1), ("user", 1), ("name", 1), ("(", 2), ("user_id", 3), ("user", 3), ("id", 3), (")", 4)]
    assert [t for t, _ in run(spark, a.code_tokens, "http.HTTPServer")][:3] == ["http.httpserver", "http", "httpserver"]


def test_filters(spark):
    assert run(spark, a.chain(a.whitespace_tokens, a.ngrams(2, 3)), "abc") == [("ab", 1), ("bc", 1), ("abc", 1)]
    assert run(spark, a.chain(a.whitespace_tokens, a.edge_ngrams(1, 2)), "abc x") == [("a", 1), ("ab", 1), ("x", 2)]
    assert run(spark, a.chain(a.whitespace_tokens, a.unique), "b a b") == [("b", 1), ("a", 2)]
    assert run(spark, a.keyword_tokens, "") == []
    assert run(spark, a.chain(a.whitespace_tokens, before=(a.strip_html,)), "a<b>c</b> > d <e") == [("a", 1), ("c", 2), ("d", 3)]


def test_synonyms_share_a_position(spark):
    assert run(spark, synonym_analyzer({"fast": ("quick", "rapid")}), "a fast car") == [("fast", 2), ("quick", 2), ("rapid", 2), ("car", 3)]


def test_registry():
    r = a.Registry()
    with pytest.raises(a.NotRegistered):
        r.get("tokenizer", "nothing")
    r.set("analyzer", "standard", a.keyword_tokens)
    assert r.analyzer("standard") is a.keyword_tokens
    r.reset()
    assert r.analyzer("standard") is not a.keyword_tokens
    assert a.analyze_text(None, "The Running foxes") == ["run", "fox"]
