"""Queries over the test tables, one for each operator, with DuckDB SQL for the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import query as q
from . import search as s
from .functions import analysis as a
from .functions.stemmer import STEP2, STEP3, STEP4
from .functions.vectors import byte_levenshtein
from .index import SearchIndex, last_operations
from .mapping import DocumentMapping, IndexMapping, boolean_field, code_field, datetime_field, keyword_field, mapped_fields, numeric_field, symbol_field, text_field, timestamps, vector_field
from .operators import facets, highlight
from .operators.codesearch import symbols
from .operators.samples import SOURCES
from .operators.scoring import bm25, tfidf
from .operators.synonyms import synonym_filter
from .plans.compiler import compile_query
from .sources.ctags import format_tags, parse_tags, tag_symbols, tags_of
from .sources.json import json_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_built: dict[tuple[str, str, str], SearchIndex] = {}


def case(name: str, sql: str | None = None):
    def take(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return take


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


DOCUMENTS = IndexMapping(DocumentMapping({"text": text_field("simple"), "lang": keyword_field(), "source": keyword_field(), "n_chars": numeric_field()}, dynamic=False))


def _index(spark: SparkSession, sf: str, name: str, make: Callable[[], SearchIndex]) -> SearchIndex:
    """One index a session and table, kept warm."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _built:
        _built[key] = make().warm()
    return _built[key]


def documents(spark: SparkSession, sf: str) -> SearchIndex:
    """``documents`` with simple words, keywords and length."""
    return _index(spark, sf, "documents", lambda: SearchIndex.of(read(spark, sf, "documents"), DOCUMENTS))


def _frame(spark: SparkSession, sf: str, table: str, id_col: str, **fields) -> SearchIndex:
    return SearchIndex.of(read(spark, sf, table), IndexMapping(DocumentMapping(fields, dynamic=False)), id_col)


def hits(index: SearchIndex, node: q.Query) -> DataFrame:
    """All matches of a query, scores rounded."""
    return compile_query(index, node).select("doc_id", F.round("score", 6).alias("score"))


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')"
PRE = rf"""WITH tok AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, {WORDS} AS t FROM documents)),
post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY doc_id),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM tok) / (SELECT count(*) FROM documents) AS avgdl),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sc AS (SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s, ln(1 + tf) * ln(n / df) / sqrt(dl) AS ti FROM post JOIN len USING (doc_id) JOIN df USING (term), st),
"""


def listed(terms: str) -> str:
    return ", ".join(f"'{t}'" for t in terms.split())


def any_of(terms: str, weight: str = "1") -> str:
    return f"SELECT doc_id, sum(s * {weight}) AS s FROM sc WHERE term IN ({listed(terms)}) GROUP BY doc_id"


def all_of(terms: str) -> str:
    return f"{any_of(terms)} HAVING count(*) = {len(terms.split())}"


def scored(body: str, ctes: str = "") -> str:
    return f"{PRE}{ctes}r AS ({body}) SELECT doc_id, round(s, 6) AS score FROM r"


def text_case(name: str, node: q.Query, body: str, ctes: str = ""):
    case(name, scored(body, ctes))(lambda spark, sf: hits(documents(spark, sf), node))


# matching

case("match_all", "SELECT doc_id, 1.0 AS score FROM documents")(lambda spark, sf: hits(documents(spark, sf), q.MatchAll()))
case("match_none", "SELECT doc_id, 1.0 AS score FROM documents WHERE false")(lambda spark, sf: hits(documents(spark, sf), q.MatchNone()))
text_case("term_bm25", q.Term("the", "text"), any_of("the"))
text_case("boost", q.Term("that", "text").boosted(2.5), any_of("that", "2.5"))
text_case("match_or", q.Match("The orantion thing", "text", analyzer="simple"), any_of("the orantion thing"))
text_case("match_and", q.Match("of the thing", "text", "and", "simple"), all_of("of the thing"))
text_case("match_repeated_term", q.Match("the the orantion", "text", analyzer="simple"), any_of("the orantion", "CASE term WHEN 'the' THEN 2 ELSE 1 END"))
text_case("prefix", q.Prefix("Ther", "text"), any_of("").replace("term IN ()", "term IN (SELECT term FROM df WHERE starts_with(term, 'ther') ORDER BY encode(term) LIMIT 1000)"))
text_case("prefix_capped", q.Prefix("t", "text"), any_of("").replace("term IN ()", "term IN (SELECT term FROM df WHERE starts_with(term, 't') ORDER BY encode(term) LIMIT 1000)"))
text_case("wildcard", q.Wildcard("Th?t*ing", "text"), any_of("").replace("term IN ()", "term IN (SELECT term FROM df WHERE regexp_full_match(term, 'th.t.*ing') ORDER BY encode(term) LIMIT 1000)"))
text_case("regexp", q.Regexp("^an[a-e]+(ed|ing)$", "text"), any_of("").replace("term IN ()", "term IN (SELECT term FROM df WHERE regexp_matches(term, '^an[a-e]+(ed|ing)$') ORDER BY encode(term) LIMIT 1000)"))
text_case("fuzzy", q.Fuzzy("orantoin", "text", 2), any_of("").replace("term IN ()", "term IN (SELECT term FROM df WHERE levenshtein(term, 'orantoin') <= 2 ORDER BY encode(term) LIMIT 1000)"))
text_case("keyword_term", q.Term("de", "lang"), "SELECT doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 / 1)) AS s FROM documents, st, (SELECT count(*) AS df FROM documents WHERE lang = 'de') WHERE lang = 'de'")
PHRASE = "SELECT DISTINCT a.doc_id, sc.s FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 AND b.term = 'the' JOIN sc ON sc.doc_id = a.doc_id AND sc.term = 'of' WHERE a.term = 'of'"
text_case("phrase", q.MatchPhrase("of the", "text", "simple"), PHRASE)
text_case("phrase_three", q.MatchPhrase("and of the", "text", "simple"), "SELECT DISTINCT a.doc_id, sc.s FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 AND b.term = 'of' JOIN tok c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 AND c.term = 'the' JOIN sc ON sc.doc_id = a.doc_id AND sc.term = 'and' WHERE a.term = 'and'")
text_case("phrase_single_term", q.MatchPhrase("orantion", "text", "simple"), any_of("orantion"))


@case("term_tfidf", PRE + "r AS (SELECT 1) SELECT doc_id, round(ti, 6) AS score FROM sc WHERE term = 'orantion'")
def term_tfidf(spark, sf):
    index = documents(spark, sf)
    return hits(SearchIndex(spark, index.mapping, index.tables, tfidf(), _stats=index.stats), q.Term("orantion", "text"))


@case("custom_scorer", PRE + "r AS (SELECT 1) SELECT doc_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 3.0 / (tf + 2.0 * (0.5 + 0.5 * dl / avgdl)), 6) AS score FROM post JOIN len USING (doc_id) JOIN df USING (term), st WHERE term = 'orantion'")
def custom_scorer(spark, sf):
    index = documents(spark, sf)
    return hits(SearchIndex(spark, index.mapping, index.tables, bm25(2.0, 0.5), _stats=index.stats), q.Term("orantion", "text"))


# ranges

case("numeric_range", "SELECT l_orderkey * 10 + l_linenumber AS doc_id, 1.0 AS score FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")(
    lambda spark, sf: hits(SearchIndex.of(read(spark, sf, "lineitem").withColumn("doc_id", F.col("l_orderkey") * 10 + F.col("l_linenumber")), IndexMapping(DocumentMapping({"l_quantity": numeric_field()}, dynamic=False))), q.NumericRange(10.0, 20.0, "l_quantity"))
)
case("numeric_range_open", "SELECT o_orderkey AS doc_id, 2.0 AS score FROM orders WHERE o_totalprice >= 100000")(lambda spark, sf: hits(_frame(spark, sf, "orders", "o_orderkey", o_totalprice=numeric_field()), q.NumericRange(100000.0, None, "o_totalprice", 2.0)))
case("date_range", "SELECT event_id AS doc_id, 1.0 AS score FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 12:00:00'")(
    lambda spark, sf: hits(_frame(spark, sf, "events", "event_id", ts=datetime_field()), q.DateRange(dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12, 12), "ts"))
)
case("date_range_open", "SELECT o_orderkey AS doc_id, 1.0 AS score FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-17'")(lambda spark, sf: hits(_frame(spark, sf, "orders", "o_orderkey", o_orderdate=datetime_field()), q.DateRange(None, dt.datetime(1995, 6, 17), "o_orderdate")))


@case("boolean_term", "SELECT doc_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS score FROM labels, (SELECT count(*) AS n, count_if(toxic = 1) AS df FROM labels) WHERE toxic = 1")
def boolean_term(spark, sf):
    rows = read(spark, sf, "labels").select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    return hits(SearchIndex.of(rows, IndexMapping(DocumentMapping({"toxic": boolean_field()}, dynamic=False))), q.Term("T", "toxic"))


# combinations

T = lambda t: q.Term(t, "text")
text_case("conjunction", q.Conjunction((T("the"), T("orantion"), q.Prefix("thing", "text")), 2.0), "SELECT doc_id, sum(s) * 2 AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY doc_id HAVING count(*) = 3", f"a AS ({any_of('the')}), b AS ({any_of('orantion')}), c AS (SELECT doc_id, sum(s) AS s FROM sc WHERE term IN (SELECT term FROM df WHERE starts_with(term, 'thing') ORDER BY encode(term) LIMIT 1000) GROUP BY doc_id),")
text_case("disjunction", q.Disjunction((T("the"), T("orantion"), q.Match("thing ciónque", "text", analyzer="simple"))), any_of("the orantion thing ciónque"))
text_case("disjunction_min2", q.Disjunction((T("the"), T("orantion"), T("thing")), 2), any_of("the orantion thing") + " HAVING count(*) >= 2")
text_case("boolean_full", q.Boolean((T("the"),), (T("orantion"),), (T("thing"),), 1.5), "SELECT doc_id, (a.s + coalesce(b.s, 0)) * 1.5 AS s FROM a LEFT JOIN b USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'thing')", f"a AS ({any_of('the')}), b AS ({any_of('orantion')}),")
text_case("boolean_should_only", q.Boolean((), (T("orantion"), T("thing")), (T("ciónque"),)), any_of("orantion thing").replace("GROUP BY", "AND doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'ciónque') GROUP BY"))
text_case("boolean_must_not_only", q.Boolean(must_not=(T("the"),)), "SELECT doc_id, 1.0 AS s FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'the')")
text_case("boolean_empty", q.Boolean(), "SELECT doc_id, 1.0 AS s FROM documents WHERE false")
text_case(
    "nested_boolean",
    q.Boolean((q.Disjunction((T("orantion"), q.Conjunction((T("und"), T("der"))))), q.NumericRange(500, None, "n_chars")), (q.Boolean((T("is"),), must_not=(T("that"),)),)),
    "SELECT doc_id, m.s + 1 + coalesce(i.s, 0) AS s FROM (SELECT doc_id, sum(s) AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id) m JOIN documents USING (doc_id) LEFT JOIN i USING (doc_id) WHERE n_chars >= 500",
    f"a AS ({any_of('orantion')}), b AS ({all_of('und der')}), i AS (SELECT * FROM ({any_of('is')}) WHERE doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'that')),",
)
THESAURUS = {"orantion": ("thing", "tiontion thshing"), "pathetic": ("worthless",)}
text_case("synonym_query", q.Synonym("Orantion pathetic", THESAURUS, "text", "simple"), any_of("orantion pathetic thing tiontion thshing worthless", "CASE WHEN term IN ('orantion', 'pathetic') THEN 1 ELSE 0.5 END"))
q.register_query("any word", lambda p: q.Match(p["text"], p["field"], analyzer="simple"))
case("named_query", scored(any_of("orantion thing")))(lambda spark, sf: hits(documents(spark, sf), q.named_query("any word", {"text": "orantion thing", "field": "text"})))

# result pages

PAGE = PRE + f"r AS ({any_of('the orantion')}) SELECT doc_id, round(s, 6) AS score FROM r ORDER BY score DESC, doc_id"
MAIN = q.Match("the orantion", "text", analyzer="simple")
case("topk", PAGE + " LIMIT 10")(lambda spark, sf: s.top_hits(compile_query(documents(spark, sf), MAIN)))
case("pagination", PAGE + " LIMIT 15 OFFSET 20")(lambda spark, sf: s.top_hits(compile_query(documents(spark, sf), MAIN), 20, 15))
case("pagination_beyond_end", PAGE + " LIMIT 10 OFFSET 100000")(lambda spark, sf: s.top_hits(compile_query(documents(spark, sf), MAIN), 100000, 10))
case("total_maxscore", PRE + f"r AS ({any_of('the orantion')}) SELECT count(*) AS total, round(max(s), 6) AS max_score FROM r")(lambda spark, sf: s.total_and_max(compile_query(documents(spark, sf), MAIN)))


@case("field_projection", f"SELECT doc_id, score, lang, source FROM ({PAGE} LIMIT 10) JOIN documents USING (doc_id)")
def field_projection(spark, sf):
    index = documents(spark, sf)
    return s.stored(index, s.top_hits(compile_query(index, MAIN)), ("lang", "source", "nowhere")).select("doc_id", "score", "lang", "source")


@case("search_request", f"SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score, lang FROM ({PAGE} LIMIT 10) JOIN documents USING (doc_id)")
def search_request(spark, sf):
    return s.search(documents(spark, sf), s.SearchRequest(MAIN, fields=("lang",))).hits.select("rank", "doc_id", "score", "lang")


@case("document", "SELECT doc_id, lang, source FROM documents WHERE doc_id = 7")
def document(spark, sf):
    row = documents(spark, sf).document(7)
    return spark.createDataFrame([(row["doc_id"], row["lang"], row["source"])], "doc_id long, lang string, source string")


case("doc_count", "SELECT count(*) AS n FROM documents")(lambda spark, sf: spark.createDataFrame([(documents(spark, sf).doc_count(),)], "n long"))
case("doc_ids", "SELECT doc_id FROM documents")(lambda spark, sf: documents(spark, sf).doc_ids())

# facets

ALL_HITS = q.Term("the", "text")
HIT_IDS = "(SELECT doc_id FROM post WHERE term = 'the')"
case("facet_terms", PRE + f"r AS {HIT_IDS} SELECT source AS term, count(*) AS count FROM documents WHERE doc_id IN (FROM r) GROUP BY source ORDER BY count DESC, term LIMIT 5")(
    lambda spark, sf: facets.top_terms(facets.term_counts(documents(spark, sf).postings("source"), compile_query(documents(spark, sf), ALL_HITS)), 5)
)
case("facet_text_terms", PRE + f"r AS {HIT_IDS} SELECT term, count(*) AS count FROM post WHERE doc_id IN (FROM r) GROUP BY term ORDER BY count DESC, term LIMIT 20")(
    lambda spark, sf: facets.top_terms(facets.term_counts(documents(spark, sf).postings("text"), compile_query(documents(spark, sf), ALL_HITS)), 20)
)


@case("facet_terms_other", PRE + f"r AS {HIT_IDS}, c AS (SELECT source, count(*) AS c FROM documents WHERE doc_id IN (FROM r) GROUP BY source) SELECT sum(c)::BIGINT AS total, (sum(c) - (SELECT sum(c) FROM (SELECT c FROM c ORDER BY c DESC, source LIMIT 5)))::BIGINT AS other, 0 AS missing FROM c")
def facet_terms_other(spark, sf):
    index = documents(spark, sf)
    got = facets.build_facet(index, compile_query(index, ALL_HITS), facets.FacetRequest("source", 5))
    return spark.createDataFrame([(got.total, got.other, got.missing)], "total long, other long, missing int")


SIZES = (facets.Range("short", None, 1000), facets.Range("middle", 500, 5000), facets.Range("long", 5000, None))
case("facet_filtered", PRE + f"r AS {HIT_IDS}, d AS (SELECT * FROM documents WHERE doc_id IN (FROM r)) SELECT 'short' AS name, count_if(n_chars <= 1000) AS count FROM d UNION ALL SELECT 'middle', count_if(n_chars BETWEEN 500 AND 5000) FROM d UNION ALL SELECT 'long', count_if(n_chars >= 5000) FROM d")(
    lambda spark, sf: facets.range_counts(documents(spark, sf).numbers("n_chars"), compile_query(documents(spark, sf), ALL_HITS), SIZES)
)
@case("facet_numeric", "WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity FROM lineitem), h AS (SELECT * FROM l WHERE id IN (SELECT id FROM l WHERE l_quantity BETWEEN 5 AND 30)) SELECT 'few' AS name, count_if(l_quantity <= 10) AS count FROM h UNION ALL SELECT 'many', count_if(l_quantity >= 10) FROM h")
def facet_numeric(spark, sf):
    index = SearchIndex.of(read(spark, sf, "lineitem").withColumn("doc_id", F.col("l_orderkey") * 10 + F.col("l_linenumber")), IndexMapping(DocumentMapping({"l_quantity": numeric_field()}, dynamic=False)))
    return facets.range_counts(index.numbers("l_quantity"), compile_query(index, q.NumericRange(5.0, 30.0, "l_quantity")), (facets.Range("few", None, 10), facets.Range("many", 10, None)))


@case("facet_date", "SELECT 'week1' AS name, count_if(ts <= TIMESTAMP '2024-01-07') AS count FROM events WHERE event_type = 'click' UNION ALL SELECT 'rest', count_if(ts >= TIMESTAMP '2024-01-07') FROM events WHERE event_type = 'click'")
def facet_date(spark, sf):
    index = _frame(spark, sf, "events", "event_id", ts=datetime_field(), event_type=keyword_field())
    week = dt.datetime(2024, 1, 7)
    return facets.range_counts(index.dates("ts"), compile_query(index, q.Term("click", "event_type")), (facets.Range("week1", None, week), facets.Range("rest", week, None)))


# vectors

_SIM = "SELECT e.vec_id, list_dot_product(e.embedding::DOUBLE[], t.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) / sqrt(list_dot_product(t.embedding::DOUBLE[], t.embedding::DOUBLE[])) AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) t"


def _knn(spark, sf, k, boost=1.0):
    index = _index(spark, sf, "embeddings", lambda: _frame(spark, sf, "embeddings", "vec_id", embedding=vector_field(64)))
    vec = read(spark, sf, "embeddings").where("vec_id = 3").select("embedding").collect()[0][0]
    return index, q.KNN(tuple(float(x) for x in vec), k, "embedding", boost)


def _knn_sql(k: int, boost: float = 1.0) -> str:
    return f"WITH s AS ({_SIM}), t AS (SELECT * FROM s WHERE sim > 0 ORDER BY round(sim, 9) DESC, vec_id LIMIT {k}) SELECT vec_id AS doc_id, round(sim / (SELECT max(sim) FROM t) * {boost}, 6) AS score FROM t"


case("knn", _knn_sql(10))(lambda spark, sf: hits(*_knn(spark, sf, 10)))
case("knn_all_positive", _knn_sql(100000, 2.0))(lambda spark, sf: hits(*_knn(spark, sf, 100000, 2.0)))
case("cosine_similarity", f"SELECT vec_id, round(sim, 6) AS sim FROM ({_SIM})")(
    lambda spark, sf: _cosine(spark, sf)
)


def _cosine(spark, sf):
    from .functions.vectors import array_literal, cosine

    e = read(spark, sf, "embeddings")
    vec = e.where("vec_id = 3").select("embedding").collect()[0][0]
    return e.select("vec_id", F.round(cosine(F.col("embedding"), array_literal(vec)), 6).alias("sim"))


@case("knn_probed", _knn_sql(10))
def knn_probed(spark, sf):
    """KNN over clustered vectors; reading all cells it is exact."""
    index, node = _knn(spark, sf, 10)
    clustered = _index(spark, sf, "clustered", lambda: index.with_cells("embedding", 12))
    return hits(clustered, replace(node, probes=12))


@case("hybrid", scored("SELECT doc_id, m.s + coalesce(k.s, 0) AS s FROM m LEFT JOIN k USING (doc_id)", f"m AS ({any_of('the')}), k AS (SELECT vec_id AS doc_id, sim / max(sim) OVER () AS s FROM (SELECT * FROM ({_SIM}) WHERE sim > 0 AND vec_id IN (SELECT doc_id FROM documents) ORDER BY round(sim, 9) DESC, vec_id LIMIT 50)),"))
def hybrid(spark, sf):
    rows = read(spark, sf, "documents").join(read(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")
    m = IndexMapping(DocumentMapping({"text": text_field("simple"), "embedding": vector_field(64)}, dynamic=False))
    _, knn = _knn(spark, sf, 50)
    return hits(_index(spark, sf, "hybrid", lambda: SearchIndex.of(rows, m)), q.Boolean((q.Term("the", "text"),), (knn,)))


# analysis

def tokens_case(name: str, analyzer: a.Analyzer, terms_sql: str, table: str = "documents", id_col: str = "doc_id", col: str = "text"):
    """Every token of a table, counted by term and position: (id, term, position)."""
    sql = f"SELECT {id_col}, unnest(t) AS term, CAST(generate_subscripts(t, 1) AS INTEGER) AS position FROM (SELECT {id_col}, {terms_sql} AS t FROM {table})"
    case(name, sql)(lambda spark, sf: a.token_rows(read(spark, sf, table), [id_col], col, analyzer))


tokens_case("tokenize_unicode", a.unicode_tokens, r"regexp_extract_all(text, '[\p{L}\p{Nd}]+')")
tokens_case("tokenize_whitespace", a.whitespace_tokens, r"regexp_extract_all(text, '[^\s\x{85}\p{Z}]+')")
tokens_case("tokenize_simple", a.registry.analyzer("simple"), r"list_transform(regexp_extract_all(text, '[\p{L}\p{Nd}]+'), lambda x: lower(x))")
tokens_case("tokenize_keyword", a.keyword_tokens, "CASE WHEN length(text) > 0 THEN [text] ELSE [] END")
tokens_case("html_strip", a.chain(a.whitespace_tokens, before=(a.strip_html,)), r"regexp_extract_all(replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '<(.|\n)*$', ''), '>', ' '), '[^\s\x{85}\p{Z}]+')", "pages", "page_id", "html")
tokens_case("punct_strip", a.chain(a.whitespace_tokens, before=(a.strip_punctuation,)), r"regexp_extract_all(regexp_replace(text, '\p{P}', ' ', 'g'), '[^\s\x{85}\p{Z}]+')")
tokens_case("trim_filter", a.chain(a.keyword_tokens, a.trim_terms), r"CASE WHEN length(x) > 0 THEN [trim(x, chr(32) || chr(9) || chr(10) || chr(13))] ELSE [] END".replace("x", "text"))

_SIMPLE = rf"SELECT doc_id, unnest(t) AS term, CAST(generate_subscripts(t, 1) AS INTEGER) AS position FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{Nd}}]+'), lambda x: lower(x)) AS t FROM documents)"
STOPPED = ", ".join(f"'{w}'" for w in a.ENGLISH_STOP_WORDS)


def filter_case(name: str, sql: str, *filters: a.Filter):
    case(name, f"WITH t AS ({_SIMPLE}) {sql}")(lambda spark, sf: a.token_rows(read(spark, sf, "documents"), ["doc_id"], "text", a.chain(a.unicode_tokens, a.lowercase, *filters)))


filter_case("stop_filter", f"SELECT * FROM t WHERE term NOT IN ({STOPPED})", a.stop_words())
filter_case("length_filter", "SELECT * FROM t WHERE length(term) BETWEEN 4 AND 7", a.length_between(4, 7))
filter_case("unique_filter", "SELECT doc_id, term, min(position) AS position FROM t GROUP BY doc_id, term", a.unique)
filter_case("edge_ngram", "SELECT doc_id, left(term, n) AS term, position FROM t, (SELECT unnest(range(2, 5)) AS n) WHERE n <= length(term)", a.edge_ngrams(2, 4))
filter_case("ngram", "SELECT doc_id, substr(term, i, n) AS term, position FROM t, (SELECT unnest(range(5, 7)) AS n), LATERAL (SELECT unnest(range(1, length(term) - n + 2)) AS i)", a.ngrams(5, 6))
filter_case(
    "synonym_filter", "SELECT * FROM t UNION ALL SELECT doc_id, syn, position FROM t JOIN (VALUES ('orantion', 'thing'), ('orantion', 'tiontion thshing'), ('pathetic', 'worthless')) v(root, syn) ON term = root", synonym_filter(THESAURUS)
)

_CODE_PARTS = r"""list_concat([raw], CASE WHEN contains(raw, '.') THEN list_filter(string_split(raw, '.'), lambda p: p <> '') ELSE [] END,
    CASE WHEN contains(raw, '_') THEN list_filter(string_split(raw, '_'), lambda p: p <> '') ELSE [] END,
    CASE WHEN len(list_filter(string_split(humps, chr(1)), lambda p: p NOT IN ('', '_'))) > 1 THEN list_filter(string_split(humps, chr(1)), lambda p: p NOT IN ('', '_')) ELSE [] END)"""
_CODE = rf"""WITH w AS (SELECT doc_id, unnest(r) AS raw, CAST(generate_subscripts(r, 1) AS INTEGER) AS position FROM (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{Nd}}_.]+|[^\p{{L}}\p{{Nd}}_.\s\x{{85}}\p{{Z}}]') AS r FROM documents)),
h AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(raw, '(\p{{Ll}})(\p{{Lu}})', '\1' || chr(1) || '\2', 'g'), '([^\x01])(\p{{Lu}}\p{{Ll}})', '\1' || chr(1) || '\2', 'g'), '([^\x01])(\p{{Lu}})$', '\1' || chr(1) || '\2') AS humps FROM w)"""
case("tokenize_code", f"{_CODE} SELECT doc_id, lower(unnest({_CODE_PARTS})) AS term, position FROM h")(lambda spark, sf: a.token_rows(read(spark, sf, "documents"), ["doc_id"], "text", a.code_tokens))
case("code_analyzer", f"{_CODE}, p AS (SELECT doc_id, lower(unnest({_CODE_PARTS})) AS term, position FROM h) SELECT doc_id, term, min(position) AS position FROM p GROUP BY doc_id, term")(
    lambda spark, sf: a.token_rows(read(spark, sf, "documents"), ["doc_id"], "text", a.registry.analyzer("code"))
)


def _stem_sql(words: str) -> str:
    """Stems of a relation of (w) as a chain of steps; strings are compared as bytes by way of their lengths."""

    def table(col: str, rules) -> str:
        whens = " ".join(f"WHEN ends_with({col}, '{x.decode()}') THEN CASE WHEN strlen({col}) - {len(x)} > 1 THEN substr({col}, 1, length({col}) - {len(x)}) || '{y.decode()}' ELSE {col} END" for x, y in rules)
        return f"CASE WHEN strlen(w) <= 2 THEN {col} {whens} ELSE {col} END"

    cut = lambda c, n: f"substr({c}, 1, length({c}) - {n})"
    tidy = lambda c: f"CASE WHEN regexp_matches({c}, '(at|bl|iz)$') THEN {c} || 'e' WHEN length({c}) > 1 AND right({c}, 1) = right({cut(c, 1)}, 1) AND strlen(right({c}, 1)) = 1 AND right({c}, 1) NOT IN ('l', 's', 'z') THEN {cut(c, 1)} ELSE {c} END"
    four = " ".join(f"WHEN ends_with(s4, '{x.decode()}') THEN CASE WHEN strlen(s4) - {len(x)} > 2" + (" AND regexp_matches(s4, '[st]ion$')" if x == b"ion" else "") + f" THEN {cut('s4', len(x))} ELSE s4 END" for x in STEP4)
    return f"""v0 AS ({words}),
v1 AS (SELECT w, CASE WHEN strlen(w) <= 2 THEN w WHEN ends_with(w, 'sses') THEN {cut("w", 2)} WHEN ends_with(w, 'ies') AND strlen(w) > 4 THEN {cut("w", 2)} WHEN ends_with(w, 's') AND NOT regexp_matches(w, '[sui]s$') AND strlen(w) > 3 THEN {cut("w", 1)} ELSE w END AS a FROM v0),
v2 AS (SELECT w, CASE WHEN strlen(w) <= 2 THEN a WHEN ends_with(a, 'eed') THEN CASE WHEN strlen(a) > 4 THEN {cut("a", 1)} ELSE a END
  WHEN ends_with(a, 'ed') AND strlen(a) > 4 AND regexp_matches({cut("a", 2)}, '[aeiou]') THEN {tidy(cut("a", 2))} WHEN ends_with(a, 'ing') AND strlen(a) > 5 AND regexp_matches({cut("a", 3)}, '[aeiou]') THEN {tidy(cut("a", 3))} ELSE a END AS b FROM v1),
v3 AS (SELECT w, CASE WHEN strlen(w) > 2 AND ends_with(b, 'y') AND strlen(b) > 2 AND regexp_matches({cut("b", 1)}, '[aeiou]') THEN {cut("b", 1)} || 'i' ELSE b END AS c FROM v2),
v4 AS (SELECT w, {table("c", STEP2)} AS s3 FROM v3),
v5 AS (SELECT w, {table("s3", STEP3)} AS s4 FROM v4),
v6 AS (SELECT w, CASE WHEN strlen(w) <= 2 THEN s4 {four} ELSE s4 END AS s5 FROM v5),
v7 AS (SELECT w, CASE WHEN strlen(w) > 2 AND ends_with(s5, 'e') AND strlen(s5) > 3 THEN {cut("s5", 1)} ELSE s5 END AS s6 FROM v6),
stem AS (SELECT w, CASE WHEN strlen(w) > 2 AND ends_with(s6, 'll') AND strlen(s6) > 3 THEN {cut("s6", 1)} ELSE s6 END AS st FROM v7)"""


@case("porter_stem", f"WITH t AS ({_SIMPLE}), {_stem_sql('SELECT DISTINCT term AS w FROM t')} SELECT w AS term, st AS stem FROM stem")
def porter_stem(spark, sf):
    from .functions.stemmer import stems

    vocabulary = read(spark, sf, "documents").select(F.explode(a.registry.analyzer("simple")(F.col("text"))["term"]).alias("term")).distinct()
    return vocabulary.select("term", stems(F.array("term"))[0].alias("stem"))


case("standard_analyzer", f"WITH t AS ({_SIMPLE}), {_stem_sql('SELECT DISTINCT term AS w FROM t')} SELECT doc_id, st AS term, position FROM t JOIN stem ON term = w WHERE term NOT IN ({STOPPED})")(
    lambda spark, sf: a.token_rows(read(spark, sf, "documents"), ["doc_id"], "text", a.registry.analyzer("standard"))
)

# statistics

case("term_stats", PRE + "r AS (SELECT 1) SELECT term, df FROM df")(lambda spark, sf: documents(spark, sf).term_stats("text"))
case("prefix_dictionary", PRE + "r AS (SELECT 1) SELECT term, df FROM df WHERE starts_with(term, 'tha')")(lambda spark, sf: documents(spark, sf).term_stats("text").where(F.col("term").startswith("tha")))
case("fuzzy_dictionary", PRE + "r AS (SELECT 1) SELECT term, levenshtein(term, 'ciónque') AS distance FROM df WHERE levenshtein(term, 'ciónque') <= 2")(
    lambda spark, sf: documents(spark, sf).term_stats("text").select("term", byte_levenshtein(F.col("term"), F.lit("ciónque"), 2).alias("distance")).where("distance >= 0")
)
case("field_lengths", PRE + "r AS (SELECT 1) SELECT 'text' AS field, doc_id, CAST(dl AS INTEGER) AS dl FROM len")(lambda spark, sf: documents(spark, sf).field_lengths().where("field = 'text'"))
case("average_length", PRE + "r AS (SELECT 1) SELECT round(avgdl, 6) AS avgdl FROM st")(lambda spark, sf: spark.createDataFrame([(round(documents(spark, sf).stats.avgdl("text"), 6),)], "avgdl double"))
case("token_frequencies", PRE + "r AS (SELECT 1) SELECT doc_id, term, CAST(count(*) AS INTEGER) AS tf, list(CAST(pos AS INTEGER) ORDER BY pos) AS positions FROM tok GROUP BY ALL")(
    lambda spark, sf: a.frequencies(read(spark, sf, "documents"), "text", a.registry.analyzer("simple"))
)
case("term_postings", PRE + "r AS (SELECT 1) SELECT doc_id, CAST(tf AS INTEGER) AS tf, CAST(dl AS INTEGER) AS dl FROM post JOIN len USING (doc_id) WHERE term = 'orantion'")(
    lambda spark, sf: documents(spark, sf).postings("text").where("term = 'orantion'").select("doc_id", "tf", "dl")
)

# changing an index


def _changed(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    new = docs.where("lang = 'es'").select("doc_id", F.lit("replaced orantion").alias("text"), "lang", "source", F.lit(17).cast("long").alias("n_chars"))
    extra = docs.where("lang = 'fr'").select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text", "lang", "source", "n_chars")
    return docs, new, extra


_MOVED = PRE.replace("FROM documents", "FROM changed").replace("WITH tok", "WITH {changed}, tok")
_UPSERT = "changed AS (SELECT doc_id, CASE WHEN lang = 'es' THEN 'replaced orantion' ELSE text END AS text FROM documents UNION ALL SELECT doc_id + 10000000, text FROM documents WHERE lang = 'fr')"
_DELETE = "changed AS (SELECT * FROM documents WHERE lang <> 'en')"
_BATCH = "changed AS (SELECT doc_id, CASE WHEN lang = 'es' THEN 'replaced orantion' ELSE text END AS text FROM documents WHERE lang <> 'fr')"


@case("upsert", _MOVED.replace("{changed}", _UPSERT) + f"r AS ({any_of('orantion')}) SELECT doc_id, round(s, 6) AS score FROM r")
def upsert(spark, sf):
    docs, new, extra = _changed(spark, sf)
    return hits(SearchIndex.of(docs, DOCUMENTS).index(new.union(extra)), q.Term("orantion", "text"))


@case("delete", _MOVED.replace("{changed}", _DELETE) + f"r AS ({any_of('der')}) SELECT doc_id, round(s, 6) AS score FROM r")
def delete(spark, sf):
    docs = read(spark, sf, "documents")
    return hits(SearchIndex.of(docs, DOCUMENTS).delete(docs.where("lang = 'en'").select("doc_id").union(spark.range(-5, -1).toDF("doc_id"))), q.Term("der", "text"))


def _operations(spark, sf) -> DataFrame:
    """Every Spanish document is deleted, then replaced; every French one replaced, then deleted."""
    docs, new, _ = _changed(spark, sf)
    french = docs.where("lang = 'fr'")
    step = lambda d, seq, op: d.select(F.lit(seq).alias("seq"), F.lit(op).alias("op"), "*")
    return step(new, 1, "delete").union(step(new, 2, "index")).union(step(french, 3, "index")).union(step(french, 4, "delete"))


@case("batch", _MOVED.replace("{changed}", _BATCH) + f"r AS ({any_of('orantion')}) SELECT doc_id, round(s, 6) AS score FROM r")
def batch(spark, sf):
    return hits(SearchIndex.of(read(spark, sf, "documents"), DOCUMENTS).batch(_operations(spark, sf)), q.Term("orantion", "text"))


case("batch_last_wins", "SELECT doc_id, CASE lang WHEN 'es' THEN 'index' ELSE 'delete' END AS op FROM documents WHERE lang IN ('es', 'fr')")(lambda spark, sf: last_operations(_operations(spark, sf)).select("doc_id", "op"))

# mapping and sources


@case("json_input", "SELECT event_id, CAST(props->>'k' AS DOUBLE) AS k FROM events")
def json_input(spark, sf):
    return json_rows(read(spark, sf, "events"), "props", "k double", ("event_id",))


@case("multi_type_mapping", "SELECT event_id AS doc_id, 1.0 AS score FROM events WHERE event_type = 'purchase' AND value >= 10 OR event_type NOT IN ('purchase', 'click') AND value >= 10")
def multi_type_mapping(spark, sf):
    number = DocumentMapping({"value": numeric_field()}, dynamic=False)
    m = IndexMapping(number, {"purchase": number, "click": DocumentMapping({"user_id": numeric_field()}, dynamic=False)}, "event_type")
    return hits(SearchIndex.of(read(spark, sf, "events").drop("props"), m, "event_id"), q.NumericRange(10.0, None, "value"))


@case("dynamic_mapping", "SELECT event_id, 'text' AS kind FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'datetime' FROM events WHERE event_id % 2 = 1")
def dynamic_mapping(spark, sf):
    """A string column in which every other value is a timestamp: routed value by value."""
    rows = read(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.when(F.col("event_id") % 2 == 1, F.lit("2024-03-01T10:00:00Z")).otherwise(F.col("event_type")).alias("v"))
    out = None
    for f in mapped_fields(rows, IndexMapping()):
        part = rows.select("doc_id", f.value.alias("x")).where("x is not null").select(F.col("doc_id").alias("event_id"), F.lit(f.mapping.type).alias("kind"))
        out = part if out is None else out.union(part)
    return out


@case("datetime_layouts", "SELECT * FROM (VALUES (1, TIMESTAMP '2024-01-02 03:04:05'), (2, TIMESTAMP '2024-01-02 01:04:05.5'), (3, TIMESTAMP '2024-01-02'), (4, TIMESTAMP '2024-01-02 03:04:05'), (5, NULL)) v(id, ts)")
def datetime_layouts(spark, sf):
    rows = spark.createDataFrame([(1, "2024-01-02T03:04:05Z"), (2, "2024-01-02T03:04:05.5+02:00"), (3, "2024-01-02"), (4, "2024-01-02T03:04:05"), (5, "2024")], "id int, t string")
    return rows.select("id", timestamps(F.col("t"), rows.schema["t"].dataType).cast("timestamp_ntz").alias("ts"))


# code

LANGUAGES = sorted(SOURCES)


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a source file: a sample in one language after the other, with a line of its own in front."""
    d = read(spark, sf, "documents")
    samples = spark.createDataFrame([(k, name, SOURCES[name][0]) for k, name in enumerate(LANGUAGES)], "k long, _lang string, body string")
    own = F.concat(F.lit("// "), F.col("source"), F.lit(" "), F.col("doc_id").cast("string"), F.lit("\n"))
    return d.withColumn("k", F.col("doc_id") % len(LANGUAGES)).join(F.broadcast(samples), "k").select("doc_id", F.concat(own, "body").alias("value"), "_lang")  # ten samples


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_FOUND = ", ".join(f"({k}, {_quoted(lang)}, {_quoted(n)}, '{kind}', '{scope}', {line + 1})" for k, lang in enumerate(LANGUAGES) for n, kind, scope, line in SOURCES[lang][1])
SYMBOLS_SQL = f"SELECT doc_id, lang AS language, name, kind, scope, line FROM (SELECT doc_id, doc_id % {len(LANGUAGES)} AS k FROM documents) JOIN (VALUES {_FOUND}) v(k, lang, name, kind, scope, line) USING (k)"


@case("symbols_regex", SYMBOLS_SQL)
def symbols_regex(spark, sf):
    return symbols(sources(spark, sf)).select("doc_id", F.inline("symbols")).select("doc_id", "language", "name", "kind", "scope", "line")


@case("symbol_query", f"WITH x AS ({SYMBOLS_SQL}), n AS (SELECT count(*) AS n FROM documents), len AS (SELECT doc_id, count(*) AS dl FROM x GROUP BY doc_id), a AS (SELECT sum(dl) / (SELECT n FROM n) AS avgdl FROM len), h AS (SELECT doc_id, count(*) AS tf FROM x WHERE lower(name) = 'total' GROUP BY doc_id) SELECT doc_id, round(ln(1 + (n - (SELECT count(*) FROM h) + 0.5) / ((SELECT count(*) FROM h) + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM h JOIN len USING (doc_id), n, a")
def symbol_query(spark, sf):
    rows = sources(spark, sf).withColumnRenamed("value", "src")
    return hits(SearchIndex.of(rows, IndexMapping(DocumentMapping({"src": symbol_field()}, dynamic=False))), q.Term("total", "src.sym"))


@case("symbol_scope_query", f"WITH x AS ({SYMBOLS_SQL}), n AS (SELECT count(*) AS n FROM documents), h AS (SELECT DISTINCT doc_id FROM x WHERE lower(scope) = 'cart') SELECT doc_id, round(ln(1 + (n - (SELECT count(*) FROM h) + 0.5) / ((SELECT count(*) FROM h) + 0.5)) * 2.2 / (1 + 1.2), 6) AS score FROM h, n")
def symbol_scope_query(spark, sf):
    rows = sources(spark, sf).withColumnRenamed("value", "src")
    return hits(SearchIndex.of(rows, IndexMapping(DocumentMapping({"src": symbol_field()}, dynamic=False))), q.Term("cart", "src.scope"))


@case("symbol_frequencies", f"SELECT lower(name) AS term, count(DISTINCT doc_id) AS df FROM ({SYMBOLS_SQL}) GROUP BY ALL")
def symbol_frequencies(spark, sf):
    rows = sources(spark, sf).withColumnRenamed("value", "src")
    return SearchIndex.of(rows, IndexMapping(DocumentMapping({"src": symbol_field()}, dynamic=False))).term_stats("src.sym")


@case("code_query", f"{_CODE}, p AS (SELECT DISTINCT doc_id, lower(unnest({_CODE_PARTS})) AS term FROM h), len AS (SELECT doc_id, count(*) AS dl FROM p GROUP BY doc_id), st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM p) / (SELECT count(*) FROM documents) AS avgdl), df AS (SELECT count(*) AS df FROM p WHERE term = 'the') SELECT doc_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM p JOIN len USING (doc_id), st, df WHERE term = 'the'")
def code_query(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", "text")
    return hits(SearchIndex.of(rows, IndexMapping(DocumentMapping({"text": code_field()}, dynamic=False))), q.Match("the", "text", analyzer="code"))


@case("ctags", f"SELECT CAST(doc_id AS VARCHAR) AS file, language, name, kind, nullif(scope, '') AS scope, line FROM ({SYMBOLS_SQL})")
def ctags(spark, sf):
    return parse_tags(format_tags(tags_of(sources(spark, sf)))).select("file", "language", "name", "kind", "scope", "line")


@case("tag_symbols", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, name, kind, scope, line FROM ({SYMBOLS_SQL})")
def tag_symbols_of(spark, sf):
    """Symbols of documents taken from tags rather than from sources."""
    return tag_symbols(parse_tags(format_tags(tags_of(sources(spark, sf))))).select("doc_id", F.inline("symbols")).select("doc_id", "name", "kind", "scope", "line")


@case(
    "token_offsets",
    r"""WITH p AS (SELECT doc_id, unnest(x) AS piece, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+') AS x FROM documents)),
o AS (SELECT *, sum(strlen(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM p)
SELECT doc_id, lower(piece) AS term, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS position, CAST(e - strlen(piece) AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end" FROM o WHERE regexp_matches(piece, '^[\p{L}\p{Nd}]')""",
)
def token_offsets(spark, sf):
    return a.token_rows(read(spark, sf, "documents"), ["doc_id"], "text", a.registry.analyzer("simple"), offsets=True)


@case("highlight")
def highlighted(spark, sf):
    index = documents(spark, sf)
    page = s.stored(index, s.top_hits(compile_query(index, MAIN)), ("text",))
    return highlight.highlight(page, "text", ["the", "orantion"], "simple").select("doc_id", "fragments")
