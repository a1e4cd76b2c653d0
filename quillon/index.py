"""The index: stored documents, postings and statistics as DataFrames, kept as Parquet.

A stored index is laid out for its reads: ``postings`` partitioned by field and ranged by
(term, document), so that a term's postings lie in few row groups and those of a frequent
term in many files; ``terms`` (the dictionary with document frequencies) by term, ``docs``
by id, ``numbers`` and ``dates`` by value.  Counts of documents and Σ lengths stand in the
pointer file.  Updates write a new snapshot and replace that file in one step, so readers
always see a whole version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import analysis, kernels
from .functions.vectors import norm
from .mapping import IndexMapping, MappedField, mapped_fields, timestamps, valid_id
from .operators import ann
from .operators.scoring import Scorer, bm25

VERSION = "2"
#: Terms of a query whose documents are counted in one pass where no dictionary is stored; for more an aggregation by term is planned.
MOST_COUNTED = 100
TABLES = ("docs", "postings", "numbers", "dates", "vectors", "symbols")
POSTING = "field string, term string, doc_id {id}, tf int, dl int, positions array<int>"


class IndexVersionError(RuntimeError):
    """A stored index of another format version."""


class DocumentNotFound(KeyError):
    """No document has the id."""


class RepeatedIds(ValueError):
    """Several rows of one input have the same id."""


#: Makes postings (term, doc_id, tf, dl, positions, field) of (doc_id, value) rows of one field; dl, where not null, is Σ tf of the document.
FieldIndexer = Callable[[DataFrame, MappedField], DataFrame]


def _analyzer(f: MappedField) -> analysis.Analyzer:
    name = "keyword" if f.mapping.type == "keyword" else "code" if f.mapping.type == "code" and f.mapping.analyzer in ("", "code") else f.mapping.analyzer
    return analysis.registry.analyzer(name)


def _counted(batches: Iterator[pa.RecordBatch], positions: bool) -> Iterator[pa.RecordBatch]:
    """Postings of rows of (doc_id, terms, places): each row's terms counted, with numpy over bounded parts of the batch."""
    for whole in batches:
        for b in kernels.slices(whole, pc.list_value_length(whole.column("terms")), kernels.SLICE // 8):
            terms, places = b.column("terms"), b.column("places")
            size = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = terms.flatten().dictionary_encode()
            doc, code = np.repeat(np.arange(b.num_rows), size), flat.indices.to_numpy()
            pos = places.flatten().to_numpy() if positions else np.arange(len(code))
            order = np.lexsort((pos, code, doc))
            doc, code = doc[order], code[order]
            head = kernels.heads(doc, code)
            ends = np.append(head, len(doc))
            spots = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(pos[order].astype(np.int32))) if positions else pa.nulls(len(head), pa.list_(pa.int32()))
            columns = [flat.dictionary.take(pa.array(code[head])), b.column("doc_id").take(pa.array(doc[head])), pa.array(np.diff(ends).astype(np.int32)), pa.array(size[doc[head]].astype(np.int32)), spots]
            yield pa.RecordBatch.from_arrays(columns, ["term", "doc_id", "tf", "dl", "positions"])


def text_postings(raw: DataFrame, f: MappedField, terms: list[str] | None = None) -> DataFrame:
    """Postings of a text field; a document's tokens are in one row, so nothing is shuffled.  With an analyzer that has an Arrow form, others than ``terms`` can be left out at once."""
    own, held = _analyzer(f), f.mapping.term_vectors
    if getattr(own, "kernel", None) is not None:

        def make(t: kernels.Tokens) -> tuple[np.ndarray, list[pa.Array]]:
            row, (term, tf, spots) = kernels.counted(t if terms is None else kernels.only(t, terms), held)
            return row, [term, tf, pa.array(t.sizes()[row].astype(np.int32)), spots]

        out = analysis.by_kernel(raw, ["doc_id"], "value", own, make, "term string, tf int, dl int, positions array<int>")
        return out.withColumn("field", F.lit(f.name))
    rows = raw.select("doc_id", own(F.col("value")).alias("tokens")).select("doc_id", F.col("tokens.term").alias("terms"), F.col("tokens.position").alias("places"))
    kind = raw.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(lambda batches: _counted(batches, held), f"term string, doc_id {kind}, tf int, dl int, positions array<int>")
    return out.withColumn("field", F.lit(f.name))


def text_tally(raw: DataFrame, f: MappedField, terms: list[str]) -> DataFrame:
    """(field, term, n): Σ tf under a null term, and the documents of each of some terms, in parts to be added up; for an analyzer that has an Arrow form."""

    def make(t: kernels.Tokens) -> tuple[list[int], list[pa.Array]]:
        some = kernels.only(t, terms)
        order, head = kernels.by_term(some)
        n = np.bincount(some.code[order[head]], minlength=len(t.terms))
        held = np.flatnonzero(n)
        names = [None, *t.terms.take(pa.array(held)).to_pylist()]
        return [0] * len(names), [pa.array(names, pa.string()), pa.array([len(t.row), *n[held].tolist()], pa.int64())]

    return analysis.by_kernel(raw, [], "value", _analyzer(f), make, "term string, n bigint").withColumn("field", F.lit(f.name))


def flag_postings(raw: DataFrame, f: MappedField) -> DataFrame:
    """A boolean is the term T or F; it has no length."""
    return raw.select(F.when(F.col("value"), "T").otherwise("F").alias("term"), "doc_id", F.lit(1).alias("tf"), F.lit(None).cast("int").alias("dl"), F.lit(None).cast("array<int>").alias("positions"), F.lit(f.name).alias("field"))


def _tally(postings: DataFrame, name: str, terms: list[str]) -> DataFrame:
    """What ``text_tally`` makes, of postings."""
    mine = [F.count_if((F.col("field") == name) & (F.col("term") == t)).alias(f"d{i}") for i, t in enumerate(terms)]
    rows = postings.groupBy("field").agg(F.sum(F.when(F.col("dl").isNotNull(), F.col("tf"))).alias("n"), *mine)
    counts = [F.struct(F.lit(t).alias("term"), F.col(f"d{i}").alias("n")) for i, t in enumerate(terms)]
    total = F.struct(F.lit(None).cast("string").alias("term"), F.col("n").alias("n"))
    return rows.select("field", F.inline(F.array(total, *counts))).where(F.col("term").isNull() | (F.col("field") == name))


@dataclass
class Stats:
    """Collection statistics of an index: documents, and Σ length of each field."""

    docs: int
    lengths: dict[str, int]

    def avgdl(self, name: str) -> float:
        return (self.lengths.get(name, 0) / self.docs if self.docs else 0.0) or 1.0


@dataclass
class SearchIndex:
    """An index over DataFrames.  Build one with ``SearchIndex.of`` or open a stored one with ``SearchIndex.open``."""

    spark: SparkSession
    mapping: IndexMapping
    tables: dict[str, DataFrame]
    scorer: Scorer = field(default_factory=bm25)
    path: str | None = None
    plugins: dict[str, object] = field(default_factory=dict)
    logger: Callable[[str], None] | None = None
    _stats: Stats | None = None
    _known: dict[str, dict[str, int]] = field(default_factory=dict)
    _cells: dict[str, np.ndarray] = field(default_factory=dict)
    #: Of an index that is not stored or kept: its documents, and what each field's postings are made of, which is read for some terms rather than all postings.
    _docs: DataFrame | None = None
    _made: list[tuple[DataFrame, MappedField | None, DataFrame]] = field(default_factory=list)

    # building

    @classmethod
    def of(cls, docs: DataFrame, mapping: IndexMapping | None = None, id_col: str = "doc_id", check_ids: bool = True, **kw) -> SearchIndex:
        """Index a DataFrame with one row a document, without running anything yet.

        Invalid ids fail when rows are read, repeated ids when documents are counted, which
        is before anything is scored or saved; ``batch`` takes several operations an id.
        """
        mapping = mapping or IndexMapping()
        mapping.validate()
        docs = docs.withColumnRenamed(id_col, "doc_id")
        if check_ids:
            docs = docs.withColumn("doc_id", F.when(valid_id(F.col("doc_id")), F.col("doc_id")).otherwise(F.raise_error(F.concat(F.lit("invalid document id: "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))))
        fields = mapped_fields(docs, mapping)
        out = cls(docs.sparkSession, mapping, {}, **kw)
        out.tables, out._docs = out._tables(docs, fields), docs
        return out

    def _tables(self, docs: DataFrame, fields: list[MappedField]) -> dict[str, DataFrame]:
        id_type = docs.schema["doc_id"].dataType.simpleString()
        empty = lambda ddl: self.spark.createDataFrame([], ddl.format(id=id_type))
        parts: dict[str, list[DataFrame]] = {t: [] for t in TABLES}
        indexers: dict[str, FieldIndexer] = {"text": text_postings, "keyword": text_postings, "code": text_postings, "boolean": flag_postings, **self.plugins.get("field_indexers", {})}
        for f in fields:
            if not f.mapping.index:
                continue
            raw = docs if f.when is None else docs.where(f.when)
            lang = ["_lang"] if f.mapping.type == "symbol" and "_lang" in docs.columns else []
            raw = raw.select("doc_id", f.value.alias("value"), *lang).where("value is not null")
            kind = f.mapping.type
            if kind in indexers:
                parts["postings"].append(indexers[kind](raw, f).selectExpr(*(c.split()[0] for c in POSTING.split(", "))))
                fast = indexers[kind] is text_postings and getattr(_analyzer(f), "kernel", None) is not None
                self._made.append((raw, f if fast else None, parts["postings"][-1]))
            elif kind == "symbol":
                from .operators.codesearch import symbol_postings, symbols

                found = symbols(raw, f.mapping.language or "auto", self.plugins.get("symbol_extractor"))
                parts["symbols"].append(found.withColumn("field", F.lit(f.name)))
                parts["postings"].append(symbol_postings(found, f.name).selectExpr(*(c.split()[0] for c in POSTING.split(", "))))
                self._made.append((raw, None, parts["postings"][-1]))
            elif kind == "numeric":
                parts["numbers"].append(raw.select(F.lit(f.name).alias("field"), "doc_id", F.col("value").cast("double").alias("value")))
            elif kind == "datetime":
                value = timestamps(F.col("value"), raw.schema["value"].dataType)
                parts["dates"].append(raw.select(F.lit(f.name).alias("field"), "doc_id", value.alias("value")).where("value is not null"))
            elif kind == "vector":
                vec = F.col("value").cast("array<float>")
                parts["vectors"].append(raw.select(F.lit(f.name).alias("field"), "doc_id", vec.alias("vec"), norm(vec).alias("norm")))
        ddl = {"postings": POSTING, "numbers": "field string, doc_id {id}, value double", "dates": "field string, doc_id {id}, value timestamp", "vectors": "field string, doc_id {id}, vec array<float>, norm double"}
        out = {"docs": self._stored(docs)}
        for t, ddl_of in ddl.items():
            frame = None
            for p in parts[t]:
                frame = p if frame is None else frame.unionByName(p)
            out[t] = frame if frame is not None else empty(ddl_of)
        if parts["symbols"]:
            frame = parts["symbols"][0]
            for p in parts["symbols"][1:]:
                frame = frame.unionByName(p)
            out["symbols"] = frame
        return out

    def _stored(self, docs: DataFrame) -> DataFrame:
        """Stored columns: all of them, but under a static mapping only those mapped and stored."""
        m = self.mapping.default
        if m.dynamic or self.mapping.types:
            drop = [n for n, f in m.fields.items() if not f.store]
            return docs.drop(*drop)
        keep = [c for c in docs.columns if c == "doc_id" or c in m.sub or (c in m.fields and m.fields[c].store)]
        return docs.select(*keep)

    # statistics and reading (the interface of a reader)

    @property
    def stats(self) -> Stats:
        """Kept with a stored index, else counted once an index version; a row a field."""
        if self._stats is None:
            self._stats = self._count(self.tables["postings"])
        return self._stats

    def _count(self, postings: DataFrame, wanted: tuple[str, list[str]] = ("", []), kept: bool = False) -> Stats:
        """The statistics, and in the same pass the document frequencies of some terms of a field; ``kept`` postings are read rather than made."""
        n, ids = self.tables["docs"].agg(F.count("*"), F.count_distinct("doc_id")).collect()[0]
        if n != ids:
            raise RepeatedIds(f"{n} rows have {ids} different ids")
        name, terms = wanted
        rows = None
        for raw, f, made in self._made if self._made and not kept else [(None, None, postings)]:
            part = text_tally(raw, f, terms if f.name == name else []) if f else _tally(made, name, terms)
            rows = part if rows is None else rows.unionByName(part)
        found = rows.groupBy("field", "term").agg(F.sum("n").alias("n")).collect()  # a row a field, and one a wanted term
        if terms:
            self._known.setdefault(name, {}).update(dict.fromkeys(terms, 0) | {r["term"]: r["n"] for r in found if r["term"] is not None})
        return Stats(n, {r["field"]: r["n"] for r in found if r["term"] is None and r["n"] is not None})

    def doc_count(self) -> int:
        return self.stats.docs

    def document(self, doc_id) -> dict:
        """The stored fields of a document."""
        rows = self.tables["docs"].where(F.col("doc_id") == F.lit(doc_id)).limit(1).collect()
        if not rows:
            raise DocumentNotFound(doc_id)
        return rows[0].asDict(recursive=True)

    def doc_ids(self) -> DataFrame:
        return self.tables["docs"].select("doc_id")

    def postings(self, name: str) -> DataFrame:
        return self.tables["postings"].where(F.col("field") == name)

    def hits(self, name: str, terms: list[str]) -> DataFrame:
        """The postings of some terms of a field."""
        if not self._made:
            return self.postings(name).where(F.col("term").isin(terms))
        out = None
        for raw, f, made in self._made:
            if f is None or f.name == name:
                part = text_postings(raw, f, terms).select(*made.columns) if f else made.where((F.col("field") == name) & F.col("term").isin(terms))
                out = part if out is None else out.unionByName(part)
        return self.postings(name).where(F.lit(False)) if out is None else out

    def term_stats(self, name: str) -> DataFrame:
        """(term, df) of a field: the stored dictionary, where there is one."""
        if "terms" in self.tables:
            return self.tables["terms"].where(F.col("field") == name).select("term", "df")
        return self.postings(name).groupBy("term").agg(F.count("*").alias("df"))

    def dfs(self, name: str, terms: list[str]) -> dict[str, int] | None:
        """Document frequencies of a query's terms, those of 0 left out: from the stored dictionary, else counted together with the statistics.  None for over ``MOST_COUNTED`` terms without a dictionary."""
        known = self._known.setdefault(name, {})
        new = [t for t in terms if t not in known]
        if new and "terms" in self.tables:
            found = {r["term"]: r["df"] for r in self.term_stats(name).where(F.col("term").isin(new)).collect()}
            known.update({t: found.get(t, 0) for t in new})
        elif len(new) > MOST_COUNTED:
            return None
        elif new:
            if self._stats is None:
                self._stats = self._count(self.tables["postings"], (name, new))
            else:
                row = self.hits(name, new).agg(*(F.count_if(F.col("term") == t) for t in new)).collect()[0]
                known.update(dict(zip(new, row, strict=True)))
        return {t: known[t] for t in terms if known[t]}

    def field_lengths(self) -> DataFrame:
        """(field, doc_id, dl) of fields that have a length."""
        return self.tables["postings"].where("dl is not null").groupBy("field", "doc_id").agg(F.first("dl").alias("dl"))

    def numbers(self, name: str) -> DataFrame:
        return self.tables["numbers"].where(F.col("field") == name)

    def dates(self, name: str) -> DataFrame:
        return self.tables["dates"].where(F.col("field") == name)

    def vectors(self, name: str) -> DataFrame:
        return self.tables["vectors"].where(F.col("field") == name)

    def with_cells(self, name: str, cells: int | None = None, sample: int = ann.SAMPLE) -> SearchIndex:
        """The index with the vectors of a field clustered, for KNN queries with ``probes``; saved and changed with the rest."""
        own = self.vectors(name)
        c = ann.fit(own, cells, sample)
        rows = self.spark.createDataFrame([(name, i, [float(x) for x in v]) for i, v in enumerate(c)], "field string, cell int, vec array<float>")
        out = dict(self.tables)
        for table, new in (("centroids", rows), ("cells", ann.assign(own, c))):
            old = self.tables.get(table)
            out[table] = new if old is None else old.where(F.col("field") != name).unionByName(new)
        return SearchIndex(self.spark, self.mapping, out, self.scorer, self.path, self.plugins, self.logger, self._stats)

    def centroids(self, name: str) -> np.ndarray:
        """The centroids of a field, kept once read; ``ann.MOST_CELLS`` at most."""
        if name not in self._cells:
            rows = self.tables["centroids"].where(F.col("field") == name).orderBy("cell").select("vec").collect()
            self._cells[name] = np.array([r["vec"] for r in rows], np.float32).reshape(len(rows), -1)
        return self._cells[name]

    def nearest_cells(self, node) -> DataFrame:
        """The vectors in the cells nearest to a KNN query."""
        if "cells" not in self.tables:
            raise ValueError(f"the vectors of {node.field!r} have no cells: see with_cells")
        return self.tables["cells"].where((F.col("field") == node.field) & F.col("cell").isin(ann.nearest(self.centroids(node.field), node.vector, node.probes)))

    def symbols_of(self, name: str, doc_id) -> DataFrame:
        if "symbols" not in self.tables:
            raise DocumentNotFound(f"no symbols of {name}")
        return self.tables["symbols"].where((F.col("field") == name) & (F.col("doc_id") == F.lit(doc_id)))

    def warm(self) -> SearchIndex:
        """Keep postings and values in memory, as far as it goes, for repeated queries."""
        self.tables = {k: t if k == "docs" else t.persist(StorageLevel.MEMORY_AND_DISK) for k, t in self.tables.items()}
        self._docs, self._made = None, []  # kept postings are read rather than made
        _ = self.stats
        return self

    def close(self) -> None:
        for t in self.tables.values():
            t.unpersist()

    def log(self, message: str) -> None:
        if self.logger:
            self.logger(message)

    # persistence

    def save(self, path: str) -> SearchIndex:
        """Write a snapshot below ``path``, make it the current one, and return the index that reads it."""
        snap = uuid.uuid4().hex
        tables = {n: t for n, t in self.tables.items() if n != "terms"}
        postings = tables["postings"].persist(StorageLevel.DISK_ONLY)  # for the counts, the dictionary, the sample of keys and the rows
        stats = self._stats = self._stats or self._count(postings, kept=True)
        tables["terms"] = postings.groupBy("field", "term").agg(F.count("*").alias("df"))
        split = {"postings": ["field"], "terms": ["field"], "cells": ["field", "cell"]}
        order = {"docs": ["doc_id"], "postings": ["field", "term", "doc_id"], "terms": ["field", "term"], "numbers": ["field", "value"], "dates": ["field", "value"]}

        def write(name: str) -> None:
            t = postings if name == "postings" else tables[name]
            if name in order:
                t = t.repartitionByRange(*order[name]).sortWithinPartitions(*order[name])
            elif name == "cells":
                t = t.repartition("field", "cell")
            w = t.write.partitionBy(*split[name]) if name in split else t.write
            w.parquet(f"{path}/{snap}/{name}")

        with ThreadPoolExecutor(4) as pool:  # small tables do not wait for large ones
            list(pool.map(write, sorted(tables, key=lambda n: n != "postings")))
        postings.unpersist()
        meta = {"version": VERSION, "snapshot": snap, "docs": stats.docs, "lengths": stats.lengths, "schemas": {n: t.schema.json() for n, t in tables.items()}}
        _replace_text(self.spark, f"{path}/meta.json", json.dumps(meta))
        self.log(f"saved {stats.docs} documents as snapshot {snap} of {path}")
        return SearchIndex.open(self.spark, path, self.mapping, scorer=self.scorer, plugins=self.plugins, logger=self.logger)

    @classmethod
    def open(cls, spark: SparkSession, path: str, mapping: IndexMapping | None = None, **kw) -> SearchIndex:
        meta = json.loads(_read_text(spark, f"{path}/meta.json"))
        if meta["version"] != VERSION:
            raise IndexVersionError(f"index version {meta['version']}, not {VERSION}")
        tables = {n: spark.read.schema(T.StructType.fromJson(json.loads(s))).parquet(f"{path}/{meta['snapshot']}/{n}") for n, s in meta["schemas"].items()}
        out = cls(spark, mapping or IndexMapping(), tables, path=path, _stats=Stats(meta["docs"], meta["lengths"]), **kw)
        out.log(f"opened snapshot {meta['snapshot']} of {path}")
        return out

    @staticmethod
    def vacuum(spark: SparkSession, path: str) -> int:
        """Delete all snapshots but the current one, once no reader uses them; how many they were."""
        current = json.loads(_read_text(spark, f"{path}/meta.json"))["snapshot"]
        root, fs = _file(spark, path)
        old = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName() != current]
        for p in old:
            fs.delete(p, True)
        return len(old)

    # changing

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> SearchIndex:
        """The index without the ids of ``deletes`` and ``upserts``, plus the rows of ``upserts``.

        Only new rows are analyzed; rows of old documents are kept by anti-joins.  Of an index
        that is not stored or kept, nothing is analyzed yet: its documents are joined, not
        their postings.
        """
        gone = None
        for part in (upserts, deletes):
            if part is not None:
                gone = part.select("doc_id") if gone is None else gone.union(part.select("doc_id"))
        if gone is None:
            return self
        gone = gone.distinct()
        if self._docs is not None:
            new = None if upserts is None else SearchIndex.of(upserts, self.mapping, plugins=self.plugins)._docs
            if new is None or sorted(new.dtypes) == sorted(self._docs.dtypes):
                left = self._docs.join(gone, "doc_id", "left_anti").select(*self._docs.columns)
                out = SearchIndex(self.spark, self.mapping, {}, self.scorer, self.path, self.plugins, self.logger)
                out._docs = left if new is None else left.unionByName(new)
                out.tables = out._tables(out._docs, mapped_fields(out._docs, self.mapping))
                return out
        kept = {n: t.join(gone, "doc_id", "left_anti").select(*t.columns) if "doc_id" in t.columns else t for n, t in self.tables.items() if n != "terms"}
        if upserts is not None:
            fresh = SearchIndex.of(upserts, self.mapping, plugins=self.plugins).tables
            for n, t in fresh.items():
                kept[n] = kept[n].unionByName(t, allowMissingColumns=True) if n in kept else t
            if "centroids" in self.tables:
                for f in [r["field"] for r in self.tables["centroids"].select("field").distinct().collect()]:
                    kept["cells"] = kept["cells"].unionByName(ann.assign(fresh["vectors"].where(F.col("field") == f), self.centroids(f)))
        return SearchIndex(self.spark, self.mapping, kept, self.scorer, self.path, self.plugins, self.logger)

    def index(self, docs: DataFrame) -> SearchIndex:
        """Insert documents, or replace those whose ids exist."""
        return self.apply(upserts=docs)

    def delete(self, ids: DataFrame) -> SearchIndex:
        """Remove documents; unknown ids are no error."""
        return self.apply(deletes=ids)

    def batch(self, operations: DataFrame) -> SearchIndex:
        """Apply (seq, op, doc_id, fields...) rows, op ``index`` or ``delete``: the last of each id counts."""
        last = last_operations(operations)
        upserts = last.where("op = 'index'").drop("op", "seq")
        return self.apply(upserts, last.where("op = 'delete'").select("doc_id"))


def last_operations(operations: DataFrame) -> DataFrame:
    """The operation of the greatest seq of each doc_id; of equal ones a deletion, then the row of the smallest hash."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("seq"), "op", F.xxhash64(*(c for c, t in operations.dtypes if not t.startswith("map"))))
    return operations.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file beside ``path`` and rename it: readers see the old text or the new, never a part."""
    p, fs = _file(spark, path)
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs
    beside = hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    how[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(p), how)


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


