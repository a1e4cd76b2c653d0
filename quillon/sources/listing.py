"""Directory trees as DataFrames: listing without contents, and contents of the files asked for.

Spark's own file sources leave out names that begin with ``_`` or ``.``.  Here each round
lists one level of directories in tasks, so that neither the tree nor its files pass
through the driver; any file system that pyarrow knows will do.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTED = "path string, directory boolean, modified timestamp, size long"
DIRECTORIES_A_TASK, BYTES_A_TASK = 64, 64 << 20


def _root(root: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (afs.LocalFileSystem(), root)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of ``spark.checkpoint.dir``; where unset, and only on a local master, in a temporary one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="quillon-state-")
        sc.setCheckpointDir(base)
    return df.checkpoint()


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, size) of every file below ``root``, paths relative to it; hidden directories are not entered, a vanished one is empty.

    The listing is a checkpoint: it does not change when it is read again.
    """

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _root(root)
        base = base.rstrip("/")
        for b in batches:
            rows = []
            for d in b.column("path").to_pylist():
                for f in fs.get_file_info(afs.FileSelector(f"{base}/{d}".rstrip("/"), allow_not_found=bool(d))):
                    if f.type in (afs.FileType.File, afs.FileType.Directory):
                        rows.append((f"{d}/{f.base_name}".lstrip("/"), f.type == afs.FileType.Directory, f.mtime, f.size if f.type == afs.FileType.File else None))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.string(), pa.bool_(), pa.timestamp("us", "UTC"), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["path", "directory", "modified", "size"])

    level, out = spark.createDataFrame([("",)], "path string"), None
    while True:
        found = checkpointed(level.mapInArrow(children, LISTED))
        files = found.where("not directory").select("path", "modified", "size")
        out = files if out is None else out.union(files)
        level = found.where("directory").where(~F.element_at(F.split("path", "/"), -1).startswith(".")).select("path")
        n = level.count()
        if not n:
            return out
        level = level.repartition(-(-n // DIRECTORIES_A_TASK))


def with_content(files: DataFrame, root: str) -> DataFrame:
    """``files`` (path, modified, size) with their bytes; a file that has vanished or cannot be read gets null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _root(root)
        for b in batches:
            for i in range(b.num_rows):  # one at a time: a batch of large files would not fit
                one = b.slice(i, 1)
                try:
                    with fs.open_input_stream(f"{base.rstrip('/')}/{one.column('path')[0].as_py()}") as f:
                        data = f.read()
                except OSError:
                    data = None
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in ("path", "modified", "size")), pa.array([data], pa.binary())], ["path", "modified", "size", "content"])

    total, n = files.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).collect()[0]
    tasks = max(1, min(n, -(-total // BYTES_A_TASK)))
    return files.select("path", "modified", "size").repartition(tasks).mapInArrow(read, "path string, modified timestamp, size long, content binary")
