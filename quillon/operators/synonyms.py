"""Synonyms: a caller-supplied thesaurus, and expansion at index time.

A thesaurus line is ``root,synonym,synonym,...``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import ENGLISH_STOP_WORDS, chain, lowercase, unicode_tokens
from ..functions.stemmer import stem


def synonym_filter(thesaurus: dict[str, tuple[str, ...]], limit: int = 10):
    """A token filter: each token, then up to ``limit`` synonyms of it at the same position."""
    def run(tokens):
        if not thesaurus:
            return tokens
        table = F.create_map(*(x for root, syns in thesaurus.items() for x in (F.lit(root.lower()), F.array(*(F.lit(s) for s in syns[:limit])))))
        more = lambda t: F.coalesce(F.element_at(table, F.lower(t["term"])), F.array().cast("array<string>"))
        return F.flatten(F.transform(tokens, lambda t: F.transform(F.concat(F.array(t["term"]), more(t)), lambda w: F.struct(w.alias("term"), t["position"].alias("position")))))

    return run



def synonym_analyzer(thesaurus: dict[str, tuple[str, ...]], limit: int = 10):
    """The standard analyzer with synonyms added before stop words go and stems are cut.

    The three filters share one Arrow function, which does each distinct word of a batch once.
    """
    table = {k.lower(): tuple(v[:limit]) for k, v in thesaurus.items()}

    def outputs(word: str) -> list[str]:
        return [stem(w) for w in (word, *table.get(word, ())) if w.lower() not in ENGLISH_STOP_WORDS]

    @F.arrow_udf("array<struct<term:string,position:int>>")
    def run(col: pa.Array) -> pa.Array:
        coded = col.flatten().dictionary_encode()
        made = [outputs(w) for w in coded.dictionary.to_pylist()]
        code = coded.indices.to_numpy(zero_copy_only=False)
        size = pc.fill_null(col.value_lengths(), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(col)), size)
        place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size) + 1
        many = np.array([len(m) for m in made], np.int64)[code] if made else np.zeros(0, np.int64)
        terms = [t for c in code.tolist() for t in made[c]]
        ends = np.searchsorted(np.repeat(row, many), np.arange(len(col) + 1)).astype(np.int32)
        items = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(np.repeat(place, many).astype(np.int32))], ["term", "position"])
        return pa.ListArray.from_arrays(pa.array(ends), items, mask=col.is_null() if col.null_count else None)

    return lambda text: run(chain(unicode_tokens, lowercase)(text)["term"])


def read_thesaurus(spark, path: str) -> DataFrame:
    """(root, synonyms) of a thesaurus file, in lower case, trimmed; lines without a synonym are left out."""
    cells = F.transform(F.split("value", ","), lambda c: F.lower(F.trim(c)))
    rows = spark.read.text(path).select(F.filter(cells, lambda c: c != "").alias("c"))
    return rows.where(F.size("c") > 1).select(F.col("c")[0].alias("root"), F.slice("c", 2, F.size("c") - 1).alias("synonyms"))


def lookup(thesaurus: DataFrame) -> dict[str, tuple[str, ...]]:
    """A thesaurus, a file's worth of words, as the dict that queries and filters take."""
    return {r["root"]: tuple(r["synonyms"]) for r in thesaurus.collect()}
