"""Held-out folds and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null ids get 0."""
    return F.coalesce(F.crc32(id_column.cast("string")) % folds, F.lit(0))


def first_by_hash(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """At most `rows` rows, those whose ids have the smallest hashes: the same rows in any run."""
    return df.orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(rows)
