"""Vector arithmetic on array columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of different length or of length zero."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def dot_with(a: Column, v) -> Column:
    """Scalar product with one vector, of arrays of its length; whole batches at once."""
    query = np.array([float(x) for x in v])

    def run(col: pa.Array) -> pa.Array:
        return pa.array(col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), len(query)) @ query)

    return F.arrow_udf(run, "double")(a)


def array_literal(v) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def byte_levenshtein(a: Column, b: Column, most: int | None = None) -> Column:
    """Edit distance over UTF-8 bytes; -1 beyond ``most``."""
    wide = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return F.levenshtein(wide(a), wide(b)) if most is None else F.levenshtein(wide(a), wide(b), most)
