import re

import pytest
from pyspark.sql import Row

from quillon import query as q
from quillon.index import SearchIndex
from quillon.mapping import DocumentMapping, IndexMapping, symbol_field
from quillon.operators.codesearch import AST_RULES, Node, RegexExtractor, Symbol, ast_extractor, ast_symbols, best_by_name, composite, resolve_language, symbols, tag_field_indexer
from quillon.operators.samples import SOURCES
from quillon.plans.compiler import compile_query
from quillon.sources.ctags import LETTERS, format_tags, parse_tags, read_tags, tag_symbols, tags_of, write_tags


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_every_language(language):
    source, want = SOURCES[language]
    found = RegexExtractor()(source, language)
    assert tuple((s.name, s.kind, s.scope, s.line) for s in found) == want and {s.language for s in found} == {language}
    raw = source.encode()
    assert all(raw[s.start_byte : s.end_byte].decode().strip() == s.signature for s in found)
    assert {s.name for s in RegexExtractor()(source, "unheard of")} >= {s.name for s in found} - {"size"} or len(RegexExtractor()(source, "unheard of")) >= len(found)


@pytest.mark.parametrize("alias,name", [("golang", "go"), ("PY", "python"), ("python3", "python"), ("JS", "javascript"), ("jsx", "javascript"), ("ts", "typescript"), ("tsx", "typescript"), ("rs", "rust"), ("cpp", "c++"), ("cc", "c++"), ("cxx", "c++"), ("rb", "ruby"), ("Java", "java")])
def test_aliases(alias, name):
    assert resolve_language(alias) == name
    assert [s.name for s in RegexExtractor()(SOURCES[name][0], alias)] == [x[0] for x in SOURCES[name][1]]


@pytest.mark.parametrize("language,line,want", [
    ("go", "func (r Repo) Save(x int) error {", ("Save", "method", "Repo")), ("go", "var debug bool", ("debug", "variable", "")), ("go", "type ID string", ("ID", "type", "")),
    ("python", "async = 1", ("async", "variable", "")), ("javascript", "const f = async (x) => x", ("f", "function", "")), ("javascript", "var g = function () {}", ("g", "function", "")),
    ("typescript", "type Id = string", ("Id", "type", "")), ("java", "public abstract class Shape {", ("Shape", "class", "")), ("java", "enum Color { RED }", ("Color", "enum", "")),
    ("rust", "pub mod net {", ("net", "module", "")), ("rust", "static SIZE: u8 = 1;", ("SIZE", "variable", "")), ("rust", "type Id = u8;", ("Id", "type", "")),
    ("c", "extern int count;", ("count", "variable", "")), ("c", "char* name(void)", ("name", "function", "")), ("c++", "template <typename T> class Box {", ("Box", "class", "")), ("c++", "template<int N> struct Arr {", ("Arr", "struct", "")),
    ("ruby", "  def self.build", ("build", "function", "")), ("ruby", "  attr_accessor :name", ("name", "property", "")), ("php", "trait Loud {", ("Loud", "trait", "")), ("php", "const MAX = 3;", ("MAX", "constant", "")),
])
def test_lines(language, line, want):
    assert want in [(s.name, s.kind, s.scope) for s in RegexExtractor()(line + "\n", language)]


def test_best_and_custom():
    kinds = ["variable", "function", "struct"]
    assert [s.kind for s in best_by_name([Symbol("x", k) for k in kinds] + [Symbol("y", "import")])] == ["struct", "import"]
    e = RegexExtractor()
    e.add_language("toy", [("function", r"^proc (?P<name>\w+)")])
    assert [s.name for s in e("proc go\n", "toy")] == ["go"]
    with pytest.raises(re.error):
        e.add_language("bad", [("x", "(")])
    assert e("", "go") == [] and len(e("\n".join(f"func f{i}() {{" for i in range(10_050)), "go")) == 10_000


def tree(kind, name, inner=(), holder="identifier"):
    return Node(kind, f"{kind} {name}", line=3, start_byte=1, end_byte=9, children=[Node(holder, name, "name"), *inner])


@pytest.mark.parametrize("language", sorted(AST_RULES))
def test_trees_of_every_language(language):
    for kind, want in AST_RULES[language].items():
        found = ast_symbols(Node("root", children=[tree(kind, "X")]), language)
        assert [(s.name, s.kind, s.language, s.line) for s in found] == [("X", want, language, 3)]


def test_trees(spark):
    root = Node("module", children=[tree("class_definition", "A", [tree("function_definition", "f", [tree("function_definition", "g")])]), Node("class_definition", "nameless")])
    assert [(s.name, s.kind, s.scope) for s in ast_symbols(root, "python")] == [("A", "class", ""), ("f", "function", "A"), ("g", "function", "A")]
    assert [n.type for n in root.walk()][:3] == ["module", "class_definition", "identifier"] and root.children[0].child("name").text == "A" and root.child("name") is None
    assert len(root.of_type("class_definition")) == 2

    def parse(source, language):
        return Node("module", children=[tree("class_definition", w) for w in source.split()]) if language == "python" else None

    docs = spark.createDataFrame([("a", "One Two", "py"), ("b", SOURCES["go"][0], "go"), ("c", None, "go"), ("d", "", "go")], "doc_id string, value string, _lang string")
    got = {r["doc_id"]: [s["name"] for s in r["symbols"]] for r in symbols(docs, extractor=ast_extractor(parse, RegexExtractor())).collect()}
    assert got["a"] == ["One", "Two"] and got["b"] == [x[0] for x in SOURCES["go"][1]] and got["c"] == got["d"] == []
    assert ast_extractor(parse)("x", "go") == []


def test_composite():
    one, two = (lambda s, k: [Symbol("f", "function"), Symbol("x", "variable")]), (lambda s, k: [Symbol("f", "function", scope="late"), Symbol("f", "method")])
    broken = lambda s, k: 1 / 0
    assert [(s.name, s.kind, s.scope) for s in composite(broken, one, two)("", "")] == [("f", "function", ""), ("x", "variable", ""), ("f", "method", "")]
    assert composite()("", "") == []


def test_tags_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(f"src:{k}", f"src/{k}", SOURCES[lang][0], lang) for k, lang in enumerate(sorted(SOURCES))], "doc_id string, path string, value string, _lang string")
    tags = tags_of(docs)
    write_tags(tags, str(tmp_path / "tags"))
    back = read_tags(spark, str(tmp_path / "tags"))
    want = {(f"src/{k}", n, kind, scope or None, line) for k, lang in enumerate(sorted(SOURCES)) for n, kind, scope, line in SOURCES[lang][1]}
    assert {(r["file"], r["name"], r["kind"], r["scope"], r["line"]) for r in back.collect()} == want
    assert {r["doc_id"] for r in tag_symbols(back).collect()} == {r["doc_id"] for r in docs.collect()}
    m = IndexMapping(DocumentMapping({"value": symbol_field()}, dynamic=False))
    index = SearchIndex.of(docs, m, plugins={"field_indexers": {"symbol": tag_field_indexer(back)}})
    plain = SearchIndex.of(docs, m)
    for node in (q.Term("cart", "value.sym"), q.Term("method", "value.kind"), q.Term("cart", "value.scope")):
        a, b = ({r["doc_id"]: round(r["score"], 9) for r in compile_query(ix, node).collect()} for ix in (index, plain))
        assert a == b and a


@pytest.mark.parametrize("kind", sorted(LETTERS))
def test_kind_letters(spark, kind):
    rows = spark.createDataFrame([Row(name="f", file="a.go", kind=kind, language="", scope="", signature="", line=7)])
    line = format_tags(rows).collect()[0]["value"]
    assert line.split("\t")[3] == LETTERS[kind] and parse_tags(format_tags(rows)).collect()[0]["kind"] == kind


@pytest.mark.parametrize("line,want", [
    ('main\tmain.go\t/^func main/;"\tf\tline:3\tlanguage:Go\tscope:x\tfoo:a:b', ("main", "main.go", "function", 3, "Go", "x", {"foo": "a:b"})),
    ("x\tf.c\t12", ("x", "f.c", None, None, None, None, {})),
    ('x\tf.c\t12;"\tkind:m\tline:z', ("x", "f.c", "method", None, None, None, {})),
    ('x\tf.c\t12;"\tq', ("x", "f.c", "q", None, None, None, {})),
    ("!_TAG_FILE\t1", None), ("junk", None), ("\tf.c\t1", None), ("", None),
])
def test_tag_lines(spark, line, want):
    got = parse_tags(spark.createDataFrame([(line,)], "value string")).collect()
    assert [(r["name"], r["file"], r["kind"], r["line"], r["language"], r["scope"], r["extra"]) for r in got] == ([want] if want else [])
