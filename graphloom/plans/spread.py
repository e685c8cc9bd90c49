"""Shuffles whose parts grow in number with the rows, so that no task's share grows."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a part, and parts below which the session's own number, joined by size, does.
ROWS, LEAST_PARTS = 500_000, 8


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` parted by ``keys`` into as many parts as ``rows`` need; few rows stay as they are. What is joined with it is spread by the same number."""
    n = -(-rows // ROWS)
    return df.repartition(n, *keys) if n >= LEAST_PARTS else df


def unsized(df: DataFrame) -> DataFrame:
    """``df`` to be joined by sort and merge whatever Spark takes its size for: that follows its files, not rows exploded or lists packed in them, and a broadcast by it can be fifty times as large."""
    return df.hint("merge")
