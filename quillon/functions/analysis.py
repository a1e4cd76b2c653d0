"""Text analysis as Column expressions.

A tokenizer takes a string column to ``array<struct<term string, position int>>``,
positions counting from 1.  Filters take such arrays to such arrays and never
renumber, so a position names a raw token of the tokenizer and thereby a place in the
text: ``with_offsets`` adds byte offsets to any analyzer's tokens.  The built-in
tokenizers and filters have the same in Arrow beside the Column (``kernels``): where a
whole chain has, tables are analyzed with it (``token_rows``, ``frequencies``), which takes
a fraction of the time; other analyzers are evaluated in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import kernels
from .stemmer import stem, stems

MAX_BYTES = 10 * 1024 * 1024
#: A set of common English words.
ENGLISH_STOP_WORDS = tuple(
    sorted(
        """i me my we our you your he him his she her it its they their who whom what which this that these then there
        a an the and or but if not no such as at by for from in into of on to with am is are was were be been being
        do does did has have had will""".split()
    )
)

TokenArray = Column
Filter = Callable[[Column], Column]
Analyzer = Callable[[Column], Column]


def number(terms: Column) -> TokenArray:
    """Tokens of an array of terms, numbered from 1."""
    return F.transform(terms, lambda t, i: F.struct(t.alias("term"), (i + 1).cast("int").alias("position")))


def on_terms(tokens: TokenArray, f: Filter) -> TokenArray:
    """Apply ``f`` to every term."""
    return F.transform(tokens, lambda t: F.struct(f(t["term"]).alias("term"), t["position"].alias("position")))


def truncate(text: Column) -> Column:
    """At most the first 10 MB of a text's bytes."""
    return F.when(F.octet_length(text) <= MAX_BYTES, text).otherwise(F.decode(F.substring(F.encode(text, "UTF-8"), 1, MAX_BYTES), "UTF-8"))


# tokenizers: ``pattern`` is what a raw token matches

UNICODE, SPACED, CODE_RAW = r"[\p{L}\p{Nd}]+", r"[^\s\x{85}\p{Z}]+", r"[\p{L}\p{Nd}_.]+|[^\p{L}\p{Nd}_.\s\x{85}\p{Z}]"


def unicode_tokens(text: Column) -> TokenArray:
    """Runs of letters and decimal digits."""
    return number(F.regexp_extract_all(text, F.lit(UNICODE), F.lit(0)))


def whitespace_tokens(text: Column) -> TokenArray:
    """Runs of anything but Unicode white space."""
    return number(F.regexp_extract_all(text, F.lit(SPACED), F.lit(0)))


def keyword_tokens(text: Column) -> TokenArray:
    """The whole text as one token; none for the empty text."""
    return number(F.when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>")))


_HUMP = r"(?<=.)(?=\p{Lu})(?:(?=\p{Lu}(?:\p{Ll}|\z))|(?<=\p{Ll}))"


def code_tokens(text: Column) -> TokenArray:
    """Identifiers and operators of source code: each, then at the same position its parts between dots, underscores and humps."""

    def parts(raw: Column) -> Column:
        full = lambda p: p != ""
        dots = F.when(F.contains(raw, F.lit(".")), F.filter(F.split(raw, r"\."), full)).otherwise(F.array().cast("array<string>"))
        unders = F.when(F.contains(raw, F.lit("_")), F.filter(F.split(raw, "_"), full)).otherwise(F.array().cast("array<string>"))
        humps = F.filter(F.split(raw, _HUMP), lambda p: (p != "") & (p != "_"))
        return F.transform(F.concat(F.array(raw), dots, unders, F.when(F.size(humps) > 1, humps).otherwise(F.array().cast("array<string>"))), F.lower)

    raws = F.regexp_extract_all(text, F.lit(CODE_RAW), F.lit(0))
    return F.flatten(F.transform(raws, lambda r, i: F.transform(parts(r), lambda p: F.struct(p.alias("term"), (i + 1).cast("int").alias("position")))))


for _f, _p in ((unicode_tokens, UNICODE), (whitespace_tokens, SPACED), (keyword_tokens, r"(?s).+"), (code_tokens, CODE_RAW)):
    _f.pattern, _f.kernel = _p, getattr(kernels, _f.__name__)  # type: ignore[attr-defined]


def with_kernel(f: Filter, kernel: kernels.FilterKernel) -> Filter:
    """A filter with its Arrow form."""
    f.kernel = kernel  # type: ignore[attr-defined]
    return f


def raw_spans(text: str, pattern: str) -> list[tuple[int, int]]:
    """Byte ranges of a text's raw tokens, in order: that of position p is at p - 1."""
    found = [m.span() for m in regex.finditer(pattern.replace(r"\x{85}", r"\x85"), text)]
    if text.isascii() or not found:
        return found
    ends = np.concatenate(([0], np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in text])))
    return [(int(ends[a]), int(ends[b])) for a, b in found]


def added(df: DataFrame, inputs: dict[str, Column], out: str, kind: str, f: Callable) -> DataFrame:
    """``df`` with a column that Python makes of the inputs of each row; a step of its own, as Spark does not find Python functions beside nested lambdas."""
    held = {f"__in{k}_{out}": c for k, c in enumerate(inputs.values())}
    schema = T.StructType([*df.schema.fields, T.StructField(out, T._parse_datatype_string(kind))])
    arrow = to_arrow_type(schema[out].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in kernels.slices(whole, pa.array(np.full(whole.num_rows, whole.nbytes // max(1, whole.num_rows)))):
                rows = zip(*(b.column(c).to_pylist() for c in names), strict=True)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in df_columns), pa.array([f(*r) for r in rows], arrow)], [*df_columns, out])

    df_columns, names = df.columns, list(held)
    return df.select(*df.columns, *(c.alias(k) for k, c in held.items())).mapInArrow(run, schema)


def with_offsets(df: DataFrame, column: str, analyzer: Analyzer, out: str = "tokens") -> DataFrame:
    """``df`` with an analyzer's tokens of a column, array<struct<term, position, start, end>>: each with the byte range of the raw token it comes from.

    Ranges are those of the text after the analyzer's character filters; null for the
    tokens of a tokenizer without a ``pattern``.
    """
    pattern, text = getattr(analyzer, "pattern", None), F.col(column)
    for f in getattr(analyzer, "before", ()):
        text = f(text)

    def place(t: str | None, tokens: list[dict] | None) -> list[dict] | None:
        if tokens is None:
            return None
        spans = raw_spans(t, pattern) if t and pattern else []
        at = lambda p: spans[p - 1] if 0 < p <= len(spans) else (None, None)
        return [{"term": x["term"], "position": x["position"], "start": at(x["position"])[0], "end": at(x["position"])[1]} for x in tokens]

    inner = getattr(analyzer, "inner", analyzer)
    kind = "array<struct<term:string,position:int,start:int,end:int>>"
    if getattr(analyzer, "kernel", None) is None:
        return added(df, {"text": truncate(text), "tokens": inner(text)}, out, kind, place)
    kernel, own, names = analyzer.kernel, kernels.alphabet(df.sparkSession), df.columns  # type: ignore[attr-defined]
    whole = pattern == keyword_tokens.pattern  # type: ignore[attr-defined]  # has no tokens for a null, others no array

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in kernels.slices(b, pc.binary_length(b.column("__text"))):
                t = part.column("__text")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), kernels.listed(kernel(t, own), None if whole else t.is_null())], [*names, out])

    schema = T.StructType([*df.schema.fields, T.StructField(out, T._parse_datatype_string(kind))])
    return df.select(*names, truncate(text).alias("__text")).mapInArrow(run, schema)


# token filters


def lowercase(tokens: TokenArray) -> TokenArray:
    return on_terms(tokens, F.lower)


lowercase.kernel = kernels.lowercase  # type: ignore[attr-defined]


def stop_words(words: tuple[str, ...] = ENGLISH_STOP_WORDS) -> Filter:
    """Drop the given words whatever their case; the rest keep their positions."""
    listed = [w.lower() for w in words]
    held = frozenset(listed)
    return with_kernel(lambda tokens: F.filter(tokens, lambda t: ~F.lower(t["term"]).isin(listed)), kernels.kept(lambda t: t not in held, lower=True))


def porter_stem(tokens: TokenArray) -> TokenArray:
    pair = F.arrays_zip(stems(tokens["term"]).alias("term"), tokens["position"].alias("position"))
    return F.transform(pair, lambda t: F.struct(t["term"].alias("term"), t["position"].alias("position")))


porter_stem.kernel = kernels.each(lambda t: [stem(t)])  # type: ignore[attr-defined]


def _spread(tokens: TokenArray, pieces: Filter) -> TokenArray:
    return F.flatten(F.transform(tokens, lambda t: F.transform(pieces(t["term"]), lambda p: F.struct(p.alias("term"), t["position"].alias("position")))))


def ngrams(low: int, high: int) -> Filter:
    """All substrings of ``low`` to ``high`` characters, by size and then place."""

    def of(term: Column) -> Column:
        n = F.char_length(term)
        sizes = F.when(n >= low, F.sequence(F.lit(low), F.least(F.lit(high), n))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(term, i, k))))

    return with_kernel(lambda tokens: _spread(tokens, of), kernels.each(lambda t: [t[i : i + k] for k in range(low, min(high, len(t)) + 1) for i in range(len(t) - k + 1)]))


def edge_ngrams(low: int, high: int) -> Filter:
    """The prefixes of ``low`` to ``high`` characters."""

    def of(term: Column) -> Column:
        n = F.char_length(term)
        sizes = F.when(n >= low, F.sequence(F.lit(low), F.least(F.lit(high), n))).otherwise(F.array().cast("array<int>"))
        return F.transform(sizes, lambda k: F.substring(term, F.lit(1), k))

    return with_kernel(lambda tokens: _spread(tokens, of), kernels.each(lambda t: [t[:k] for k in range(low, min(high, len(t)) + 1)]))


def trim_terms(tokens: TokenArray) -> TokenArray:
    """White space off both ends of each term."""
    return on_terms(tokens, lambda t: F.regexp_replace(t, r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+\z", ""))


def length_between(low: int, high: int = 0) -> Filter:
    """Keep terms of ``low`` to ``high`` characters; 0 for no upper bound."""
    return with_kernel(lambda tokens: F.filter(tokens, lambda t: (F.char_length(t["term"]) >= low) & (F.lit(high == 0) | (F.char_length(t["term"]) <= high))), kernels.kept(lambda t: low <= len(t) and (high == 0 or len(t) <= high)))


def unique(tokens: TokenArray) -> TokenArray:
    """The first token of each term, by position: sorted by term, each is compared with the one before."""
    kind = "struct<term:string,position:int>"
    ordered = F.array_sort(tokens.cast(f"array<{kind}>"))
    before = F.slice(F.concat(F.array(F.lit(None).cast(kind)), ordered), F.lit(1), F.size(ordered))
    fresh = F.filter(F.zip_with(ordered, before, lambda x, y: F.when(y.isNull() | (x["term"] != y["term"]), x)), lambda t: t.isNotNull())
    by_place = F.array_sort(F.transform(fresh, lambda t: F.struct(t["position"].alias("position"), t["term"].alias("term"))))
    return F.transform(by_place, lambda t: F.struct(t["term"].alias("term"), t["position"].alias("position")))


unique.kernel = kernels.unique  # type: ignore[attr-defined]


# character filters


def strip_html(text: Column) -> Column:
    """Tags become a blank, as does a stray ``>``; an unclosed ``<`` drops what follows."""
    return F.translate(F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]*>", " "), r"(?s)<.*\z", ""), ">", " ")


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{P}", " ")


def chain(tokenizer: Analyzer, *filters: Filter, before: tuple[Filter, ...] = ()) -> Analyzer:
    """An analyzer: character filters, tokenizer, token filters."""

    def inner(text: Column) -> TokenArray:
        tokens = tokenizer(truncate(text))
        for f in filters:
            tokens = f(tokens)
        return tokens

    def run(text: Column) -> TokenArray:
        for f in before:
            text = f(text)
        return inner(text)

    run.pattern, run.before, run.inner = getattr(tokenizer, "pattern", None), before, inner  # type: ignore[attr-defined]
    steps = [getattr(f, "kernel", None) for f in (tokenizer, *filters)]

    def kernel(texts: pa.Array, own: kernels.Alphabet) -> kernels.Tokens:
        tokens = steps[0](texts, own)
        for f in steps[1:]:
            tokens = f(tokens, own)
        return tokens

    run.kernel = kernel if all(steps) else None  # type: ignore[attr-defined]
    return run


def raw_text(text: Column, analyzer: Analyzer) -> Column:
    """The text that an analyzer's tokenizer reads: after the character filters and cut to 10 MB; a bare tokenizer reads all."""
    for f in getattr(analyzer, "before", ()):
        text = f(text)
    return truncate(text) if hasattr(analyzer, "inner") else text


def by_kernel(df: DataFrame, ids: list[str], column: str, analyzer: Analyzer, make: Callable, schema: str) -> DataFrame:
    """What ``make`` makes, in Arrow columns, of the tokens of each slice of a table; the ids it names go with the rows."""
    kernel, own = analyzer.kernel, kernels.alphabet(df.sparkSession)  # type: ignore[attr-defined]
    kept = ", ".join(f"`{i}` {df.schema[i].dataType.simpleString()}" for i in ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in kernels.slices(b, pc.binary_length(b.column("__text"))):
                row, columns = make(kernel(part.column("__text"), own))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(row)) for i in ids), *columns], names)
            pa.default_memory_pool().release_unused()

    out = f"{kept}, {schema}" if ids else schema
    names = [*ids, *(x.strip().split()[0].strip("`") for x in schema.split(","))]
    return df.select(*ids, raw_text(F.col(column), analyzer).alias("__text")).mapInArrow(run, out)


def token_rows(df: DataFrame, ids: list[str], column: str, analyzer: Analyzer, offsets: bool = False) -> DataFrame:
    """The ids, term and position, with ``offsets`` also start and end, of every token of a column: ``F.inline(analyzer(column))`` with the analyzer's Arrow form where it has one."""
    if getattr(analyzer, "kernel", None) is None:
        if offsets:
            return with_offsets(df.select(*ids, column), column, analyzer, "__tokens").select(*ids, F.inline("__tokens"))
        return df.select(*ids, F.inline(analyzer(F.col(column))))
    schema = "term string, position int" + (", `start` int, `end` int" if offsets else "")
    return by_kernel(df, ids, column, analyzer, lambda t: (t.row, kernels.flat_columns(t, offsets)), schema)


#: Repeated ids up to this number are told to every task; more are joined.
MANY_REPEATED = 1_000_000


def by_repeats(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose id no other row has, and the rest, None without any; counts the ids at once."""
    found = df.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("n")).where("n > 1").select("__key")
    n = found.count()
    if not n:
        return df, None
    found = F.broadcast(found) if n <= MANY_REPEATED else found
    same = F.col(key).eqNullSafe(F.col("__key"))
    return df.join(found, same, "left_anti"), df.join(found, same, "left_semi")


def _summed(flat: DataFrame, doc_id: str) -> DataFrame:
    spots = [F.sort_array(F.collect_list(c)).alias(f"{c}s") for c in ("position", "start", "end") if c in flat.columns]
    return flat.groupBy(doc_id, "term").agg(F.count("*").cast("int").alias("tf"), *spots)


def token_frequencies(tokens_df: DataFrame, doc_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(doc_id, term, tf, positions) of a frame with a column of tokens; starts and ends too where the tokens have offsets.

    A row's terms are counted in the row; only rows that share an id are brought together.
    """
    once, again = by_repeats(tokens_df, doc_id)
    kind = tokens_df.schema[tokens].dataType.elementType
    places = [c for c in ("position", "start", "end") if c in kind.names]
    named = [f"{c}s" for c in places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in kernels.slices(whole, pc.list_value_length(whole.column("term")), kernels.SLICE // 8):
                size = pc.fill_null(pc.list_value_length(b.column("term")), 0).to_numpy(zero_copy_only=False)
                flat = b.column("term").flatten().dictionary_encode(null_encoding="encode")
                row, code = np.repeat(np.arange(b.num_rows), size), flat.indices.to_numpy(zero_copy_only=False)
                order = np.lexsort((code, row))
                head = kernels.heads(row[order], code[order])
                lists = []
                for c in places:
                    own = b.column(c).flatten()
                    there = own.is_valid().to_numpy(zero_copy_only=False)
                    value = pc.fill_null(own, 0).to_numpy(zero_copy_only=False)
                    by_value = np.lexsort((value, code, row))
                    ends = np.concatenate(([0], np.cumsum(there[by_value])))[np.append(head, len(row))].astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(value[by_value][there[by_value]].astype(np.int32))))
                at, tf = order[head], np.diff(np.append(head, len(row))).astype(np.int32)
                terms = flat.dictionary.take(pa.array(code[at]))
                yield pa.RecordBatch.from_arrays([b.column(doc_id).take(pa.array(row[at])), terms, pa.array(tf), *lists], [doc_id, "term", "tf", *named])

    flat = once.select(doc_id, F.col(f"{tokens}.term").alias("term"), *(F.col(f"{tokens}.{c}").alias(c) for c in places))
    out = flat.mapInArrow(run, f"`{doc_id}` {tokens_df.schema[doc_id].dataType.simpleString()}, term string, tf int, {', '.join(f'{c} array<int>' for c in named)}")
    return out if again is None else out.unionByName(_summed(again.select(doc_id, F.inline(tokens)), doc_id))


def frequencies(df: DataFrame, column: str, analyzer: Analyzer, doc_id: str = "doc_id") -> DataFrame:
    """``token_frequencies`` of a column, with the analyzer's Arrow form where it has one."""
    if getattr(analyzer, "kernel", None) is None:
        return token_frequencies(df.select(doc_id, analyzer(F.col(column)).alias("tokens")), doc_id)
    once, again = by_repeats(df.select(doc_id, column), doc_id)
    out = by_kernel(once, [doc_id], column, analyzer, kernels.counted, "term string, tf int, positions array<int>")
    return out if again is None else out.unionByName(_summed(token_rows(again, [doc_id], column, analyzer), doc_id))


STANDARD, SIMPLE = chain(unicode_tokens, lowercase, stop_words(), porter_stem), chain(unicode_tokens, lowercase)


class NotRegistered(KeyError):
    """No component of that kind and name."""


class Registry:
    """Named analyzers, tokenizers, token filters and character filters; setting a name again replaces it."""

    KINDS = ("analyzer", "tokenizer", "token_filter", "char_filter")

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        """Back to the components that come with the library."""
        self._held: dict[tuple[str, str], Callable] = {}
        for name, f in {"unicode": unicode_tokens, "whitespace": whitespace_tokens, "keyword": keyword_tokens, "code": code_tokens}.items():
            self.set("tokenizer", name, f)
        for name, f in {"lowercase": lowercase, "stop_en": stop_words(), "porter_stem": porter_stem, "trim": trim_terms, "unique": unique}.items():
            self.set("token_filter", name, f)
        self.set("char_filter", "html", strip_html)
        self.set("analyzer", "standard", STANDARD)
        self.set("analyzer", "simple", SIMPLE)
        self.set("analyzer", "keyword", chain(keyword_tokens))
        self.set("analyzer", "whitespace", chain(whitespace_tokens))
        self.set("analyzer", "code", chain(code_tokens, lowercase, unique))

    def set(self, kind: str, name: str, component: Callable) -> None:
        if kind not in self.KINDS:
            raise NotRegistered(kind)
        self._held[kind, name] = component

    def get(self, kind: str, name: str) -> Callable:
        try:
            return self._held[kind, name]
        except KeyError:
            raise NotRegistered(f"no {kind} named {name!r}") from None

    def analyzer(self, name: str) -> Analyzer:
        return self.get("analyzer", name or "standard")

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self._held if k == kind)


registry = Registry()


def analyze_text(spark, text: str, analyzer: str = "standard") -> list[str]:
    """The terms of one string; query texts are analyzed with it."""
    if analyzer == "keyword":
        return [text] if text else []
    fast = _local(text, analyzer)
    if fast is not None:
        return fast
    own = registry.analyzer(analyzer)
    if getattr(own, "kernel", None) is not None and not own.before and len(text.encode("utf-8", "surrogatepass")) <= MAX_BYTES:
        return own.kernel(pa.array([text]), kernels.alphabet(spark)).flat().to_pylist()
    row = spark.createDataFrame([(text,)], "t string").select(own(F.col("t")).alias("x")).collect()[0]
    return [t["term"] for t in row["x"] or []]


_BUILT_IN = {"standard": STANDARD, "simple": SIMPLE}


def _local(text: str, analyzer: str) -> list[str] | None:
    """Terms for the two common analyzers without a Spark job, for ASCII text."""
    if not text.isascii() or _BUILT_IN.get(analyzer) is not registry.analyzer(analyzer):
        return None
    low = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return low if analyzer == "simple" else [stem(w) for w in low if w not in ENGLISH_STOP_WORDS]
