"""Corpus preparation: five stages, each written as Parquet and read again by the next.

quality -> near-duplicates -> benchmark leaks -> personal data -> token ids.
SQL expresses none of the trained, iterated or tokenising stages, so ORACLE_SQL is None;
the tests hold ``run`` against a brute-force version.

Every stage decides row by row on whole texts: rows with a null id take part like others,
repeated rows are near-duplicates of each other, null texts pass through all stages (and
end with null ids), empty ones too (and end with none), an empty table stays empty, and
columns beside doc_id and text are carried along whatever their names, up to the last
stage, which returns doc_id, n_tokens, ids and exact.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, decontam, pii, quality, simhash
from quillon.llm.common import delete_path, shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps: see ``quality.good_only``.

    Without a labelled document, all, with a warning; a null text counts as empty.
    """
    return quality.good_only(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: see ``simhash.keep_one``.

    Of texts under one id each is a document; texts without a word, and null ones, all stay.
    """
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item: see ``decontam.without_leaks``.

    Null and empty texts hold none; an empty benchmark removes nothing.
    """
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and secrets replaced: see ``pii.redact``.

    Each row by its own text; null and empty texts stay as they are.
    """
    return pii.redact(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: see ``bpe.encode``.  A null text has null ids, an empty one none."""
    return bpe.encode(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each kept in the shared folder until the next has been written; the last table stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        out = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            delete_path(spark, before)
        before = out
    return docs
