"""All pairs of vectors within groups, exactly, as products of tiles.

A group is cut into slices of ``TILE`` vectors at most, and each two slices meet in one tile: two matrices, multiplied. A group of any size is thus as many tasks'
work as it has tiles, none of which holds more than two slices; small groups are worked through one after the other from a sorted stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a slice.
TILE = 1024


def tiles(vectors: DataFrame, by: list[str], key: str, tile: int = TILE) -> DataFrame:
    """``vectors`` once for each tile of their group that they belong to: (_i, _j) are the tile's slices, ``_slice`` the row's own.

    A slice is chosen by the hash of ``key``, so slices have about ``tile`` rows; the group's size is counted first.
    """
    sizes = vectors.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.ceil(F.count("*") / tile).cast("int").alias("_slices"))
    same = vectors[by[0]].eqNullSafe(sizes[f"_{by[0]}"])
    for c in by[1:]:
        same = same & vectors[c].eqNullSafe(sizes[f"_{c}"])
    cut = vectors.join(sizes, same).withColumn("_slice", F.pmod(F.xxhash64(key), F.col("_slices")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))
    return cut.withColumn("_other", other).select(*vectors.columns, "_slice", F.least("_slice", "_other").alias("_i"), F.greatest("_slice", "_other").alias("_j"))


def per_tile(tiled: DataFrame, by: list[str], compare: Callable[[pa.Table, pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``compare(a, b)`` of each tile's two slices, the same one twice where a slice meets itself.

    Tiles are sorted within tasks, and a task holds one tile at a time.
    """
    keys = [*by, "_i", "_j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        at = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                whole = pa.concat_tables(held)
                first = whole.column("_slice").to_numpy() == at[-2]
                low = whole.filter(pa.array(first))
                yield compare(low, low if at[-1] == at[-2] else whole.filter(pa.array(~first)))

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            # rows of a tile are neighbours: it ends where a key changes
            ends = np.zeros(batch.num_rows, bool)
            ends[-1] = True
            for c in keys:
                codes = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                ends[:-1] |= codes[1:] != codes[:-1]
            start = 0
            for end in np.flatnonzero(ends) + 1:
                own = tuple(batch.column(c)[start].as_py() for c in keys)
                if own != at:
                    yield from done()
                    held.clear()
                    at = own
                held.append(table.slice(start, end - start))
                start = end
        yield from done()

    return tiled.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one size as rows of length 1, zero vectors as they are, in double precision."""
    flat = column.combine_chunks()
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)
