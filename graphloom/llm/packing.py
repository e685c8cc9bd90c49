"""Best-fit packing by the sum-of-squares rule.

Every document becomes its token ids and an end id; those longer than a sequence are
cut. A piece of a whole sequence fills one. The others are dealt by hash into groups
whose number grows with the input and whose size doesn't, and each group is packed on
its own: a piece goes where the sum over residual gaps of the squared number of open
sequences with that gap becomes smallest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import rows_of, slices
from graphloom.llm.encoding import encoder
from graphloom.plans.scratch import materialise

CAPACITY = 2048
END_ID = 0
#: Pieces of a group that is packed alone; each group can waste a few sequences.
GROUP = 150_000
#: Share of a group, its shortest pieces, that comes last and in mixed order to fill the gaps.
MIXED = 0.25
_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document; ``with_ids`` adds its ids as unsigned 32-bit bytes.

    Null text is empty and gives the end id alone. The first piece takes what is
    left over by whole sequences. Repeated rows are packed once each.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end, width = encoder(path, keep_space=True), int(end_id).to_bytes(4, "little"), 4 * capacity
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(5 + with_ids)]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = memoryview(ids_of(text) + end)
                at = 0
                stop = len(ids) % width or width
                for piece in range(-(-len(ids) // width)):
                    row = (doc, piece, at // 4, (stop - at) // 4, zlib.crc32(ids[at:stop]))
                    for column, value in zip(out, row + ((bytes(ids[at:stop]),) if with_ids else ()), strict=True):
                        column.append(value)
                    at, stop = stop, stop + width
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names[: len(out)])

    return rows_of(docs, "doc_id", "text").mapInArrow(encode, _PIECE + ", ids binary" * with_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, in the order given.

    Moving a bin from gap g to g - s changes the sum by 2 (N[g-s] - N[g]) + 2, filling one
    by 1 - 2 N[s]; opening one adds 2 N[capacity-s] + 1.
    Ties go to the smallest gap, and an open bin goes before a new one.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)  # counts[0] stays 0: full bins aren't open
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened, far = 0, np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        here = counts[s:capacity]
        fresh = 2 * counts[capacity - s] + (s < capacity)
        best = None
        if len(here):
            change = 2 * (counts[: capacity - s] - here) + 2
            change[0] = 1 - 2 * here[0]
            change[here == 0] = far
            k = int(change.argmin())
            if here[k] and change[k] <= fresh:
                best = s + k
        if best is None:
            gap, bin_ = capacity, opened
            opened += 1
        else:
            gap, bin_ = best, stacks[best].pop()
            counts[gap] -= 1
        bins[i], offsets[i] = bin_, capacity - gap
        if gap > s:
            counts[gap - s] += 1
            stacks[gap - s].append(bin_)
    return bins, offsets


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to rows of :func:`pieces`; an empty table stays empty."""
    parts = materialise(parts, "pieces")
    groups = parts.where(F.col("length") < capacity).count() // group + 1
    schema = f"{', '.join(f'`{n}` {k}' for n, k in parts.dtypes)}, sequence_id bigint, offset bigint"

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="_group").sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        first = len(rows) - int(len(rows) * MIXED)
        mixed = first + np.random.default_rng(0).permutation(len(rows) - first)
        rows = rows.iloc[np.concatenate([np.arange(first), mixed])].reset_index(drop=True)
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=(int(key[0]) << 40) + bins, offset=offsets)

    part = (
        parts.where(F.col("length") < capacity)
        .withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)))  # equal rows spread as well
        .groupBy("_group")
        .applyInPandas(place, schema)
    )
    whole = parts.where(F.col("length") >= capacity).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")}
    )
    return part.unionByName(whole)


def best_fit_packing(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, group: int = GROUP) -> DataFrame:
    """Tokenize, cut and pack ``docs`` (doc_id, text); see :func:`pieces` and :func:`pack`."""
    return pack(pieces(docs, public_tokenizers.path(tokenizer), capacity, end_id, with_ids), capacity, group)
