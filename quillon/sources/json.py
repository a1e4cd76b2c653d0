"""JSON text as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame, column: str, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of a JSON column by a declared schema, beside those of ``keep``; malformed text fails the query."""
    return df.select(*keep, F.from_json(column, schema, {"mode": "FAILFAST"}).alias("__j")).select(*keep, "__j.*")
