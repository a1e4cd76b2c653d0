"""A directory of files as documents."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .listing import list_tree, with_content
from ..mapping import DocumentMapping, IndexMapping, code_field, datetime_field, keyword_field, numeric_field, static_document, symbol_field, text_field, vector_field

MAX_SIZE = 10 * 1024 * 1024
LANGUAGES = {
    "go": "go", "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "rs": "rust",
    "c": "c", "h": "c", "cc": "c++", "cpp": "c++", "cxx": "c++", "hpp": "c++", "hh": "c++", "rb": "ruby", "php": "php",
}
SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"  # of Spark's binaryFile


def path_id(path: Column) -> Column:
    """The document id of a relative path (which must not hold a colon to come back unchanged)."""
    return F.translate(path, "/", ":")


def id_path(doc_id: Column) -> Column:
    return F.translate(doc_id, ":", "/")


def language_of(ext: Column) -> Column:
    """Language by file extension, without the dot; null for others."""
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.element_at(table, F.lower(ext))


def wanted(files: DataFrame, max_size: int = MAX_SIZE, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """The files of a listing that become documents, told from path and size alone; ``keep`` filters by path, null counts as no."""
    rows = files.where(F.col("size") <= max_size)
    return rows if keep is None else rows.where(F.coalesce(keep(F.col("path")), F.lit(False)))


def safe_embed(embed: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """A Column function of a Python one that makes vectors of texts; texts that it fails on get null."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str) -> list[float] | None:
            try:
                return None if t is None else [float(x) for x in embed([t])[0]]
            except Exception:  # a document without a vector is a document still
                return None

        try:
            return pd.Series([[float(x) for x in v] for v in embed(list(texts))], dtype=object)
        except Exception:
            return pd.Series([one(t) for t in texts], dtype=object)

    return run


def file_documents(files: DataFrame, fts: bool = True, code: bool = False, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Documents of (path, modified, size, content) rows; files with a NUL in their first 512 bytes, or no content, are left out.

    ``embed`` makes a vector of the content.
    """
    rows = files.where("content is not null").where(F.instr(F.decode(F.substring("content", 1, 512), "ISO-8859-1"), "\x00") == 0)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    text = F.decode("content", "UTF-8")
    out = {
        "doc_id": path_id(F.col("path")), "path": F.col("path"), "filename": name, "filename_text": F.regexp_replace(name, r"[._-]+", " "), "ext": ext,
        "size": F.col("size").cast("double"), "modified": F.col("modified"), "content": text if fts else None, "code": text if code else None, "source": text if code else None,
        "_lang": language_of(F.ltrim(ext, F.lit("."))) if code else None, "embedding": embed(text) if embed else None,
    }
    return rows.select(*(c.alias(k) for k, c in out.items() if c is not None))


def read_directory(spark, root: str, max_size: int = MAX_SIZE, keep: Callable[[Column], Column] | None = None, **options) -> DataFrame:
    """Documents of all files below ``root``, whatever their names begin with."""
    return file_documents(with_content(wanted(list_tree(spark, root), max_size, keep), root), **options)


def file_mapping(fts: bool = True, code: bool = False, dims: int = 0) -> IndexMapping:
    """The static mapping of file documents."""
    m: DocumentMapping = static_document()
    for k in ("path", "filename", "ext"):
        m.add(k, keyword_field())
    m.add("filename_text", text_field()).add("size", numeric_field()).add("modified", datetime_field())
    if fts:
        m.add("content", text_field())
    if code:
        m.add("code", code_field()).add("source", symbol_field())
    if dims:
        m.add("embedding", vector_field(dims))
    return IndexMapping(default=m)
