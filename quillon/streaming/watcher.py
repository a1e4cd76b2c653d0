"""Continuous ingest of a directory.

A file stream reports new files only, so each round lists the directory, names, times and
sizes alone, and compares the list with the last one: contents are read of new and
changed files only; those are upserted and vanished ones deleted, in one step for the
consumer or in steps of so many files.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import MAX_SIZE, SCHEMA, file_documents, path_id, wanted
from ..sources.listing import checkpointed, list_tree, with_content


def changes(listing: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (path, modified, size) listings: the rows that are new or changed, and the paths that are gone."""
    same = ["path", "modified", "size"]
    return listing.join(known, same, "left_anti"), known.join(listing, "path", "left_anti").select("path")


class Watcher:
    """Polls a directory; ``consume(upserts, deletes)`` gets documents and ids of each round that changed something.

    With ``batch`` files a step, ``consume`` is called for each so many changed files, and
    gets the deletions with the first step.  State is replaced only after all steps have
    returned; a listing that fails deletes nothing.
    """

    def __init__(
        self, spark: SparkSession, root: str, consume: Callable[[DataFrame, DataFrame], None], seconds: float = 10.0, batch: int = 0, max_size: int = MAX_SIZE,
        keep: Callable[[Column], Column] | None = None, logger: Callable[[str], None] | None = None, **options,
    ):
        self.spark, self.root, self.consume, self.seconds, self.batch, self.options = spark, root, consume, seconds, batch, options
        self.limits, self.logger = (max_size, keep), logger
        self.known = spark.createDataFrame([], "path string, modified timestamp, size long")
        self._stop, self._thread = threading.Event(), None

    def scan(self) -> tuple[int, int]:
        """One round: how many files were new or changed, and how many gone."""
        now = checkpointed(wanted(list_tree(self.spark, self.root), *self.limits))
        fresh, gone = (checkpointed(x) for x in changes(now, self.known))
        n, m = fresh.count(), gone.count()
        if n or m:
            ids = gone.select(path_id(F.col("path")).alias("doc_id"))
            steps = max(1, -(-n // self.batch)) if self.batch else 1
            if steps > 1:
                fresh = checkpointed(fresh.withColumn("step", F.ntile(steps).over(Window.orderBy("path")) - 1))  # names only
            for k in range(steps):
                part = fresh.where(F.col("step") == k) if steps > 1 else fresh
                self.consume(file_documents(with_content(part, self.root), **self.options), ids if k == 0 else ids.limit(0))
            self.known = now
        return n, m

    def start(self) -> None:
        """Scan now, then every ``seconds`` until ``stop``; a round that fails is tried again by the next."""
        self.scan()

        def loop() -> None:
            while not self._stop.wait(self.seconds):
                try:
                    self.scan()
                except Exception as e:
                    if self.logger:
                        self.logger(f"scan of {self.root} failed: {e}")

        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join()


def stream_new_files(spark: SparkSession, root: str, consume: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 10, max_size: int = MAX_SIZE, keep: Callable[[Column], Column] | None = None, **options):
    """A Structured Streaming query that hands documents of new files to ``consume(docs, batch)``; for append-only directories.

    Spark's file stream leaves out names that begin with ``_`` or ``.``; ``Watcher`` does not.
    """
    clean = lambda c: F.regexp_replace(c, r"^[a-z0-9]+:/+", "/")
    path = F.substring(clean(F.col("path")), F.length(clean(F.lit(root.rstrip("/")))) + 2, 1 << 20)
    files = spark.readStream.schema(SCHEMA).format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.select(path.alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")
    docs = file_documents(wanted(files, max_size, keep), **options)
    return docs.writeStream.foreachBatch(consume).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
