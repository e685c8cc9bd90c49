"""Small helpers of the operators in this package."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of text that a Python step holds as vectors at a time.
SLICE_CHARS = 4_000_000

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``chars`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(text)), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(ends.searchsorted(base + chars, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def rows_of(docs: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, absent ones as null: extra columns can't clash with an operator's own."""
    have = set(docs.columns)
    kinds = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
    return docs.select(*[(docs[c] if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in columns])


def text_key(text: Column | str) -> Column:
    """Tells rows that share a doc_id apart; equal rows stay one document."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def is_row(docs: DataFrame, named: DataFrame) -> Column:
    """Join condition of rows of ``docs`` (doc_id, text, anything else) with their names (doc_id, t) in a written table."""
    return docs["doc_id"].cast("bigint").eqNullSafe(named["doc_id"]) & (text_key(docs["text"]) == named["t"])


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows that the written table ``gone`` (doc_id, t) names by id and text; a null id equals a null id."""
    return docs.join(gone, is_row(docs, gone), "left_anti")


#: Rows that a table of the commonest keys can have: each key of it has more than one in so many of all rows.
HEAVY = 10_000


def join_counted(rows: DataFrame, classes: DataFrame, keys: list[str], total: int, times: str = "times") -> DataFrame:
    """Inner join of ``rows`` to ``classes``, which has each key once with its number of rows.

    Keys of more than ``total`` / ``HEAVY`` of the ``total`` rows number less than ``HEAVY``, so their classes are broadcast and
    their rows stay where they are; the rest, without a hot key left, is shuffled.
    """
    hot = F.col(times) > total / HEAVY
    heavy, light = F.broadcast(classes.where(hot)), classes.where(~hot)
    return rows.join(heavy, keys).unionByName(rows.join(heavy.select(*keys), keys, "left_anti").join(light, keys))
