"""Symbols of source code: line patterns and AST rules for ten languages, and their postings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.kernels import slices

#: Symbols are looked for in so many bytes of sources at a time.
SLICE = 1 << 20
MOST_SYMBOLS = 10_000
SYMBOLS = "array<struct<name:string,kind:string,language:string,scope:string,signature:string,line:int,start_byte:int,end_byte:int>>"
RANK = dict.fromkeys("struct interface class enum trait".split(), 3) | dict.fromkeys("function method constant".split(), 2) | dict.fromkeys("type variable field property".split(), 1)
ALIASES = {"golang": "go", "py": "python", "python3": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "cpp": "c++", "cc": "c++", "cxx": "c++", "rb": "ruby"}

#: kind: pattern, ``name`` and, where there is one, ``scope`` being named groups; several patterns of a kind are numbered.
_RULES: dict[str, list[tuple[str, str]]] = {}


def _language(name: str, text: str, base: str | None = None) -> None:
    rules = list(_RULES[base]) if base else []
    for line in text.strip().splitlines():
        kind, pattern = line.strip().split(None, 1)
        pattern = re.sub(r"~(\w+)~", r"(?:\1\\s+)?", pattern)  # a word that may be left out
        rules.append((kind, pattern.replace("NAME", r"(?P<name>\w+)").replace("SCOPE", r"(?P<scope>\w+)")))
    _RULES[name] = rules


_language("go", r"""
    method ^func\s+\(\w+\s+\*?SCOPE\)\s+NAME\s*\(
    function ^func\s+NAME\s*\(
    struct ^type\s+NAME\s+struct\b
    interface ^type\s+NAME\s+interface\b
    type ^type\s+NAME\s+\S
    variable ^var\s+NAME\s+
    field ^\s+NAME\s+\w+.*`json:"\w+"
    constant ^const\s+NAME\s*=
    constant ^\s+NAME\s*=
    package ^package\s+NAME
""")
_language("python", r"""
    class ^class\s+NAME
    method ^\s+def\s+NAME\s*\(
    function ^def\s+NAME\s*\(
    variable ^NAME\s*=
    import ^import\s+NAME
    import ^from\s+NAME\s+import
""")
_language("javascript", r"""
    class ^~export~class\s+NAME
    function ^~export~function\s+NAME\s*\(
    function ^~export~(?:var|let|const)\s+NAME\s*=\s*~async~(?:function|\()
    constant ^~export~const\s+NAME\s*=
    variable ^~export~(?:let|var)\s+NAME\s*=
    method ^\s+NAME\s*[(].*[)]\s*[{]
    import ^import\s.*\sfrom\s+["'](?P<name>[\w./@-]+)["']
""")
_language("typescript", r"""
    interface ^~export~interface\s+NAME
    type ^~export~type\s+NAME\s*=
    enum ^~export~enum\s+NAME
""", "javascript")
_language("java", r"""
    class (?:abstract|protected|private|public)?\s*class\s+NAME
    interface (?:abstract|protected|private|public)?\s*interface\s+NAME
    enum (?:abstract|protected|private|public)?\s*enum\s+NAME
    method (?:final|synchronized|abstract|static|protected|private|public)\s+[\w\s<>,\[\]]+\s+NAME\s*\(
    method ^\s*NAME\s*[(][^)]*[)]\s*[{]
    field [\w<>\[\]]+\s+NAME\s*=
    package ^package\s+(?P<name>[\w.]+)
    import ^import\s+~static~(?P<name>[\w.]+)
""")
_language("rust", r"""
    function ^~pub~fn\s+NAME\s*[(<]
    method ^\s+~pub~fn\s+NAME\s*\(
    struct ^~pub~struct\s+NAME
    enum ^~pub~enum\s+NAME
    trait ^~pub~trait\s+NAME
    type ^~pub~type\s+NAME\s*=
    constant ^~pub~const\s+NAME\s*:
    variable ^~pub~static\s+NAME\s*:
    module ^~pub~mod\s+NAME
    import ^use\s+(?P<name>[\w:]+)
""")
_language("c", r"""
    function ^~static~~inline~~extern~[*\w]+\s+NAME\s*[(][^;]*$
    struct ^struct\s+NAME\s*\{
    type ^typedef\s+.*\s+NAME\s*;
    enum ^enum\s+NAME\s*\{
    constant ^\#define\s+NAME
    variable ^~extern~[*\w]+\s+NAME\s*;
""")
_language("c++", r"""
    class ^class\s+NAME
    module ^namespace\s+NAME
    class ^template\s*<.+>\s*class\s+NAME
    struct ^template\s*<.+>\s*struct\s+NAME
    method SCOPE::NAME\s*\(
""", "c")
_language("ruby", r"""
    class ^class\s+NAME
    module ^module\s+NAME
    function ^\s+def\s+self\.NAME
    method ^\s+def\s+(?P<name>\w+[=!?]?)
    function ^def\s+(?P<name>\w+[=!?]?)
    variable ^\s+NAME\s*=
    constant ^NAME\s*=
    property ^\s+attr_(?:writer|reader|accessor)\s+:NAME
    import ^require\s+["'](?P<name>[\w/-]+)["']
""")
_language("php", r"""
    class ^~abstract~class\s+NAME
    interface ^interface\s+NAME
    trait ^trait\s+NAME
    method (?:static|protected|private|public)\s+function\s+NAME\s*\(
    function ^function\s+NAME\s*\(
    constant ^(?:define|const)\s*[(]?\s*["']*NAME
    module ^namespace\s+(?P<name>[\w\\]+)
    import ^use\s+(?P<name>[\w\\]+)
""")  # fmt: skip


def resolve_language(name: str) -> str:
    """The language that a name or an alias, in any case, stands for."""
    low = name.lower()
    return ALIASES.get(low, low)


@dataclass(frozen=True)
class Symbol:
    name: str
    kind: str
    language: str = ""
    scope: str = ""
    signature: str = ""
    line: int = 0
    start_byte: int = 0
    end_byte: int = 0


#: source, language -> symbols
Extractor = Callable[[str, str], list[Symbol]]


def best_by_name(found: list[Symbol]) -> list[Symbol]:
    """One symbol a name, of the most specific kind, in the place where the name was first seen."""
    out: dict[str, Symbol] = {}
    for s in found:
        if s.name not in out or RANK.get(s.kind, 0) > RANK.get(out[s.name].kind, 0):
            out[s.name] = s
    return list(out.values())


class RegexExtractor:
    """Symbols by line patterns; for an unknown language, those of the language that finds most (of equals the first by name)."""

    def __init__(self) -> None:
        self.rules = {k: [(kind, re.compile(p)) for kind, p in v] for k, v in _RULES.items()}

    def add_language(self, name: str, rules: list[tuple[str, str]]) -> None:
        """Add or replace a language; a bad pattern raises ``re.error``."""
        self.rules[name] = [(kind, re.compile(p)) for kind, p in rules]

    def __call__(self, source: str, language: str) -> list[Symbol]:
        language = resolve_language(language)
        if language in self.rules:
            return self._scan(source, language)
        tried = [self._scan(source, k) for k in sorted(self.rules)]
        return max(tried, key=len, default=[])

    def _scan(self, source: str, language: str) -> list[Symbol]:
        found, at = [], 0
        for n, line in enumerate(source.split("\n"), 1):
            size = len(line.encode("utf-8", "surrogatepass"))
            for kind, pattern in self.rules[language]:
                m = pattern.search(line)
                if m:
                    parts = m.groupdict()
                    found.append(Symbol(parts["name"], kind, language, parts.get("scope") or "", line.strip(), n, at, at + size))
            at += size + 1
            if len(found) >= MOST_SYMBOLS:
                break
        return best_by_name(found[:MOST_SYMBOLS])


@dataclass
class Node:
    """A node of a syntax tree that a caller's parser made."""

    type: str
    text: str = ""
    field_name: str = ""
    line: int = 0
    start_byte: int = 0
    end_byte: int = 0
    children: list[Node] = field(default_factory=list)

    def child(self, name: str) -> Node | None:
        return next((c for c in self.children if c.field_name == name), None)

    def of_type(self, kind: str) -> list[Node]:
        return [c for c in self.children if c.type == kind]

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            yield from c.walk()


#: language -> node type -> kind; the name is the child in field ``name``, else the first identifier.
_NODE_KINDS = "function_declaration:function method_declaration:method function_definition:function method_definition:method class_declaration:class class_definition:class interface_declaration:interface struct_declaration:struct enum_declaration:enum variable_declaration:variable"
AST_RULES: dict[str, dict[str, str]] = {
    k: dict(x.split(":") for x in v.split())
    for k, v in {
        "generic": _NODE_KINDS,
        "go": "function_declaration:function method_declaration:method type_spec:type struct_type:struct interface_type:interface const_spec:constant var_spec:variable field_declaration:field package_clause:package",
        "python": "class_definition:class function_definition:function assignment:variable import_statement:import import_from_statement:import",
        "javascript": "class_declaration:class function_declaration:function method_definition:method variable_declarator:variable import_statement:import arrow_function:function",
        "typescript": "class_declaration:class function_declaration:function method_definition:method variable_declarator:variable import_statement:import arrow_function:function interface_declaration:interface type_alias_declaration:type enum_declaration:enum",
        "java": "class_declaration:class interface_declaration:interface enum_declaration:enum method_declaration:method constructor_declaration:method field_declaration:field package_declaration:package import_declaration:import",
        "rust": "function_item:function struct_item:struct enum_item:enum trait_item:trait type_item:type const_item:constant static_item:variable mod_item:module use_declaration:import impl_item:class",
        "c": "function_definition:function struct_specifier:struct enum_specifier:enum type_definition:type preproc_def:constant declaration:variable",
        "c++": "function_definition:function struct_specifier:struct enum_specifier:enum type_definition:type preproc_def:constant declaration:variable class_specifier:class namespace_definition:module template_declaration:class",
        "ruby": "class:class module:module method:method singleton_method:function assignment:variable",
    }.items()
}


def ast_symbols(root: Node, language: str) -> list[Symbol]:
    """Symbols of a syntax tree, each with its nearest named enclosing scope."""
    rules = AST_RULES.get(language, AST_RULES["generic"])
    out: list[Symbol] = []

    def visit(n: Node, scope: str) -> None:
        kind, inner = rules.get(n.type), scope
        if kind:
            name = n.child("name") or next((c for c in n.children if c.type.endswith("identifier")), None)
            if name and name.text:
                out.append(Symbol(name.text, kind, language, scope, n.text.split("\n")[0].strip(), n.line, n.start_byte, n.end_byte))
                inner = name.text if kind in ("class", "struct", "interface", "trait", "enum", "module") else scope
        for c in n.children:
            visit(c, inner)

    visit(root, "")
    return out


def ast_extractor(parse: Callable[[str, str], Node | None], fallback: Extractor | None = None) -> Extractor:
    """An extractor that parses with the caller's parser; a source that it has no tree for goes to ``fallback``."""

    def run(source: str, language: str) -> list[Symbol]:
        root = parse(source, resolve_language(language))
        if root is None:
            return fallback(source, language) if fallback else []
        return ast_symbols(root, resolve_language(language))

    return run


def tag_field_indexer(tags: DataFrame) -> Callable[[DataFrame, object], DataFrame]:
    """A field indexer that takes the symbols of each document from a table of tags instead of its source."""
    from ..sources.ctags import tag_symbols

    def run(raw: DataFrame, f) -> DataFrame:
        return symbol_postings(tag_symbols(tags).join(raw.select("doc_id"), "doc_id", "left_semi"), f.name)

    return run


def composite(*extractors: Extractor) -> Extractor:
    """All extractors' symbols, the first of each (name, kind); one that fails is skipped."""

    def run(source: str, language: str) -> list[Symbol]:
        out: dict[tuple[str, str], Symbol] = {}
        for e in extractors:
            try:
                for s in e(source, language):
                    out.setdefault((s.name, s.kind), s)
            except Exception:  # a broken extractor must not lose the others' symbols
                continue
        return list(out.values())

    return run


def symbols(sources: DataFrame, language: str = "auto", extractor: Extractor | None = None) -> DataFrame:
    """(doc_id, symbols) of (doc_id, value[, _lang]) rows; the row's own language goes first."""
    extract = extractor or RegexExtractor()
    kind = T._parse_datatype_string(SYMBOLS)
    item = to_arrow_type(kind.elementType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, pc.binary_length(whole.column("value")), SLICE):
                found = [list(extract(t, k)) if t else [] for t, k in zip(b.column("value").to_pylist(), b.column("lang").to_pylist(), strict=True)]
                flat = [s for one in found for s in one]
                columns = [pa.array([getattr(s, f.name) for s in flat], f.type) for f in item]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields=list(item)))], ["doc_id", "symbols"])

    lang = F.coalesce("_lang", F.lit(language)) if "_lang" in sources.columns else F.lit(language)
    return sources.select("doc_id", "value", lang.alias("lang")).mapInArrow(run, T.StructType([sources.schema["doc_id"], T.StructField("symbols", kind)]))


def symbol_postings(found: DataFrame, name: str) -> DataFrame:
    """Postings of the sub-fields .sym (lower-cased names, with a length), .kind and .scope (lower-cased)."""
    flat = found.select("doc_id", F.inline("symbols"))
    parts = F.array(
        F.struct(F.lit(f"{name}.sym").alias("field"), F.lower("name").alias("term")),
        F.struct(F.lit(f"{name}.kind").alias("field"), F.col("kind").alias("term")),
        F.struct(F.lit(f"{name}.scope").alias("field"), F.lower("scope").alias("term")),
    )
    rows = flat.select("doc_id", F.inline(parts)).where("term <> ''").groupBy("field", "term", "doc_id").agg(F.count("*").cast("int").alias("tf"))
    dl = F.sum("tf").over(Window.partitionBy("field", "doc_id")).cast("int")
    return rows.withColumn("dl", F.when(F.col("field").endswith(".sym"), dl)).withColumn("positions", F.lit(None).cast("array<int>"))
