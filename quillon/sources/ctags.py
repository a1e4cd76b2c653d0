"""ctags: reading and writing tag files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = {"function": "f", "method": "m", "class": "c", "struct": "s", "interface": "i", "enum": "e", "type": "t", "variable": "v", "constant": "d", "field": "F", "property": "p", "module": "n", "package": "P", "import": "I", "trait": "T"}
KINDS = {v: k for k, v in LETTERS.items()}


def parse_line(line: Column) -> Column:
    """name, file, address, kind, language, scope, signature, line and the other ``key:value`` extras of a tag line."""
    cut = F.instr(line, ';"')
    head = F.split(F.when(cut > 0, F.substring(line, F.lit(1), cut - 1)).otherwise(line), "\t", 3)
    tail = F.filter(F.split(F.when(cut > 0, F.substring(line, cut + 2, F.length(line))).otherwise(F.lit("")), "\t"), lambda x: x != "")
    pairs = F.filter(tail, lambda x: F.contains(x, F.lit(":")))
    extra = F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda p: F.substring_index(p, ":", 1))), lambda k: F.struct(k, F.substring(F.element_at(F.filter(pairs, lambda p: F.substring_index(p, ":", 1) == k), -1), F.length(k) + 2, F.length(line)))))
    bare = F.try_element_at(F.filter(tail, lambda x: ~F.contains(x, F.lit(":"))), F.lit(1))
    kind = F.coalesce(bare, F.element_at(extra, "kind"))
    named = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    rest = F.map_filter(extra, lambda k, _: ~k.isin("kind", "line", "language", "scope", "signature"))
    return F.struct(
        F.get(head, 0).alias("name"), F.get(head, 1).alias("file"), F.get(head, 2).alias("address"), F.coalesce(F.element_at(named, kind), kind).alias("kind"),
        F.element_at(extra, "language").alias("language"), F.element_at(extra, "scope").alias("scope"), F.element_at(extra, "signature").alias("signature"),
        F.element_at(extra, "line").try_cast("int").alias("line"), rest.alias("extra"),
    )


def parse_tags(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tags of text lines; comments (``!_``) and lines without a name and a file are left out."""
    rows = lines.where(~F.col(column).startswith("!_") & F.contains(F.col(column), F.lit("\t")))
    return rows.select(parse_line(F.col(column)).alias("t")).select("t.*").where("name <> ''")


def read_tags(spark, path: str) -> DataFrame:
    return parse_tags(spark.read.text(path))


def format_tags(symbols: DataFrame) -> DataFrame:
    """One column ``value``: a tag line for each row of name, file, kind, language, scope, signature, line."""
    letter = F.create_map(*(F.lit(x) for kv in LETTERS.items() for x in kv))
    extra = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{c}:"), F.col(c).cast("string")))
    fields = F.concat_ws("\t", "name", "file", F.concat(F.col("line").cast("string"), F.lit(';"')), F.coalesce(F.element_at(letter, F.col("kind")), F.col("kind")), *map(extra, ("line", "language", "scope", "signature")))
    return symbols.select(fields.alias("value"))


def tags_of(sources: DataFrame, language: str = "auto", extractor=None) -> DataFrame:
    """name, file, kind, language, scope, signature, line of every symbol in (doc_id, value[, path][, _lang]) rows: what a tag file of them would hold."""
    from ..operators.codesearch import symbols

    path = "path" if "path" in sources.columns else "doc_id"
    rows = symbols(sources, language, extractor).join(sources.select("doc_id", F.col(path).cast("string").alias("file")), "doc_id") if path != "doc_id" else symbols(sources, language, extractor).withColumn("file", F.col("doc_id").cast("string"))
    return rows.select("file", F.inline("symbols")).select("name", "file", "kind", "language", "scope", "signature", "line")


def tag_symbols(tags: DataFrame) -> DataFrame:
    """(doc_id, symbols): the tags of each file as its symbols, ids made of paths; what ``symbol_postings`` takes."""
    from ..operators.codesearch import SYMBOLS
    from .files import path_id

    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    one = F.struct("name", "kind", none("language").alias("language"), none("scope").alias("scope"), none("signature").alias("signature"), F.coalesce("line", F.lit(0)).alias("line"), F.lit(0).alias("start_byte"), F.lit(0).alias("end_byte"))
    return tags.groupBy(path_id(F.col("file")).alias("doc_id")).agg(F.array_sort(F.collect_list(one)).cast(SYMBOLS).alias("symbols"))


def write_tags(symbols: DataFrame, path: str) -> None:
    format_tags(symbols).sort("value").write.text(path)
