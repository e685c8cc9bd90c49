"""Embedding near-duplicates by collision-counting projections.

There are ``tables`` of one-dimensional random projections. Each sorts the vectors inside the cells of
its sign bits, and a window around each vector, as wide as linked vectors can lie apart, holds its
collisions. Pairs that collide in at least ``LEAST_COUNT`` tables are verified exactly.
The number of sign bits follows the number of vectors, so cells keep their size, and the number
of tables is the smallest that gives the wanted recall at the threshold itself; closer pairs are found more
surely. Equal vectors collapse first.

Cells and places are worked out once per vector and travel with it, so that every task sees the same ones. A pair is
handled in the first table where it collides, so its count needs no shuffle and no pair leaves a task: tasks return link
counts and spanning links. A cell of more vectors than a tile is cut along the sorted projection into slots of one window's width; a
slot meets itself and the next one, tile by tile, and slots further apart never meet.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import join_counted
from graphloom.plans.fixpoint import connected_components
from graphloom.plans.scratch import discard, materialise, materialise_at

COSINE = 0.9
#: Recall that tables are counted for, of pairs exactly at the threshold.
RECALL = 0.96
LEAST_COUNT = 2
#: Vectors of a cell on average, and of one tile of a larger cell at most.
CELL, TILE = 128, 1024
_SEED = 20_240_229


def calibrated(bits: int, cosine: float = COSINE, recall: float = RECALL, count: int = LEAST_COUNT) -> tuple[int, float]:
    """(tables, half window): enough tables that pairs at ``cosine`` collide ``count`` times with this probability.

    Sign bits agree with probability 1 - angle / pi each; the window holds 99 % of the differences of
    projections at that distance.
    """
    window = 2.5758 * math.sqrt(2 - 2 * cosine)
    p = (1 - math.acos(cosine) / math.pi) ** bits * 0.99
    tables = count
    while sum(math.comb(tables, k) * p**k * (1 - p) ** (tables - k) for k in range(count)) > 1 - recall:
        tables += 1
    return tables, window


@cache
def _directions(size: int, tables: int, bits: int) -> np.ndarray:
    """(size, tables * (bits + 1)): the sign directions and the sorted one of each table."""
    return np.random.default_rng(_SEED).standard_normal((size, tables * (bits + 1)))


def _projected(units: np.ndarray, tables: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and places along the sorted projection, a column per table."""
    values = (units @ _directions(units.shape[1], tables, bits)).reshape(len(units), tables, bits + 1)
    cells = ((values[:, :, :bits] > 0) << np.arange(bits)).sum(axis=2)
    return cells.astype("<i4"), values[:, :, bits].astype("<f4")


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def _packed(x: np.ndarray) -> list[bytes]:
    """Vectors as bytes, in single precision where that loses nothing."""
    short = x.astype("<f4")
    kept = (short == x).all(axis=1)
    return [(short if k else x)[i].tobytes() for i, k in enumerate(kept.tolist())]


def _unpacked(packed: list[bytes], size: int) -> np.ndarray:
    if all(len(b) == 4 * size for b in packed):
        return np.frombuffer(b"".join(packed), "<f4").reshape(-1, size).astype(np.float64)
    return np.array([np.frombuffer(b, "<f4" if len(b) == 4 * size else "<f8") for b in packed], np.float64)


def _tile(table: int, cells: np.ndarray, places: np.ndarray, left: np.ndarray, right: np.ndarray, window: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a in left, b in right) of one cell that first collide in this table, and ``LEAST_COUNT`` times in all.

    ``cells`` and ``places`` have a row per table. Equal sides give each pair once.
    """
    out = []
    rows = max(1, 400_000 // max(1, len(right)))
    for begin in range(0, len(left), rows):
        mine = left[begin : begin + rows]
        near = np.abs(places[table][mine][:, None] - places[table][right]) <= window
        if left is right:
            near &= mine[:, None] < right
        count = np.ones(near.shape, np.uint8)
        for other in range(len(cells)):
            if other == table:
                continue
            hits = np.flatnonzero((cells[other][mine][:, None] == cells[other][right]) & near)
            if not len(hits):
                continue
            a, b = mine[hits // len(right)], right[hits % len(right)]
            hits = hits[np.abs(places[other][a] - places[other][b]) <= window]
            if other < table:
                near.reshape(-1)[hits] = False  # an earlier table has it
            else:
                count.reshape(-1)[hits] += 1
        a, b = np.nonzero(near & (count >= LEAST_COUNT))
        out.append((mine[a], right[b]))
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Positions of links that join what no earlier link has joined."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return np.array(kept, dtype=np.int64)


def linked(distinct: DataFrame, cosine: float = COSINE, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """Rows (vec_id, other, n): with ``other`` a link that spans; without, ``n`` more vectors linked to vec_id.

    ``distinct`` holds (vec_id, embedding, copies), each direction's vectors once, all finite; only vectors of one size meet.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    bits = max(1, math.ceil(math.log2(max(2, total / CELL))))
    tables, window = calibrated(bits, cosine, recall)

    def project(frames):
        for frame in frames:
            for size, part in frame.groupby(frame["embedding"].map(len), sort=False):
                vectors = np.array(part["embedding"].tolist(), np.float64)
                cells, places = _projected(_units(vectors), tables, bits)
                yield pd.DataFrame({
                    "vec_id": part["vec_id"].to_numpy(), "copies": part["copies"].to_numpy(), "size": size, "cells": list(cells),
                    "slots": list(np.floor(places / np.float32(window)).astype(np.int32)),
                    "keys": [a.tobytes() + b.tobytes() for a, b in zip(cells, places, strict=True)], "vector": _packed(vectors),
                })

    schema = "vec_id bigint, copies bigint, size int, cells array<int>, slots array<int>, keys binary, vector binary"
    placed, path = materialise_at(distinct.select("vec_id", "embedding", "copies").mapInPandas(project, schema), "vectors")
    spots = placed.select("vec_id", "copies", "size", "keys", "vector", F.posexplode(F.arrays_zip("cells", "slots")).alias("t", "at")).select(
        "vec_id", "copies", "size", "keys", "vector", "t", F.col("at.cells").alias("cell"), F.col("at.slots").alias("slot")
    )
    cell = ["size", "t", "cell"]
    large = spots.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > tile).select(*cell)
    slots, slots_path = materialise_at(
        spots.join(large, cell, "left_semi").groupBy(*cell, "slot").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")), "slots"
    )
    bundle = F.pmod(F.xxhash64("cell"), F.lit(total // tile + 1))  # cells that fit one tile travel together, about as many vectors as a tile holds
    zero = F.lit(0)
    held = ["vec_id", "copies", "keys", "vector", "cell"]
    whole = spots.select("size", "t", bundle.alias("bundle"), *[zero.alias(c) for c in ("a_slot", "a_part", "b_slot", "b_part")], zero.alias("slot"), zero.alias("part"), *held)
    full = whole
    if not slots.isEmpty():
        beside = lambda by, name: slots.select(*cell, (F.col("slot") + by).alias("slot"), F.col("parts").alias(name))
        around = slots.join(beside(-1, "after"), [*cell, "slot"], "left").join(beside(1, "before"), [*cell, "slot"], "left").fillna(0, ["after", "before"])
        cut = spots.join(around, [*cell, "slot"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
        until = lambda n: F.when(F.col(n) > 0, F.sequence(zero, F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
        pair = lambda a, i, b, j: F.struct(a.alias("a_slot"), i.alias("a_part"), b.alias("b_slot"), j.alias("b_part"))
        slot, part = F.col("slot"), F.col("part")
        pairs = F.concat(
            F.transform(until("parts"), lambda k: pair(slot, F.least(part, k), slot, F.greatest(part, k))),
            F.transform(until("after"), lambda k: pair(slot, part, slot + 1, k)),
            F.transform(until("before"), lambda k: pair(slot - 1, k, slot, part)),
        )
        tiles = cut.withColumn("pair", F.explode(pairs)).select("size", "t", (-1 - F.col("cell")).cast("bigint").alias("bundle"), "pair.*", "slot", "part", *held)
        small = spots.join(large, cell, "left_anti")
        full = small.select("size", "t", bundle.alias("bundle"), *[zero.alias(c) for c in ("a_slot", "a_part", "b_slot", "b_part")], zero.alias("slot"), zero.alias("part"), *held).unionByName(tiles)

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["cell", "vec_id"], ignore_index=True)
        keys = np.frombuffer(b"".join(frame["keys"]), "<i4").reshape(len(frame), 2 * tables).T.copy()
        cells, places = keys[:tables], keys[tables:].view("<f4")
        size, table, a_side, b_side = key[0], key[1], key[3:5], key[5:7]
        slot, part = frame["slot"].to_numpy(), frame["part"].to_numpy()
        pairs = []
        for here in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(frame["cell"])) + 1):
            left = right = here
            if a_side != b_side:
                left, right = (here[(slot[here] == s) & (part[here] == p)] for s, p in (a_side, b_side))
            if len(left) and len(right) > (left is right):
                pairs.append(_tile(table, cells, places, left, right, window))
        a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
        near = np.zeros(len(a), bool)
        if len(a):
            units = _units(_unpacked(frame["vector"].tolist(), size))
            for begin in range(0, len(a), 50_000):
                k = slice(begin, begin + 50_000)
                near[k] = np.einsum("ij,ij->i", units[a[k]], units[b[k]]) >= cosine
        a, b = a[near], b[near]
        ids, copies = frame["vec_id"].to_numpy(), frame["copies"].to_numpy()
        n = np.bincount(a, copies[b], len(frame)) + np.bincount(b, copies[a], len(frame))
        touched = np.flatnonzero(n)
        span = _spanning(a, b, len(frame))
        return pd.DataFrame({
            "vec_id": np.concatenate([ids[touched], ids[a[span]]]),
            "other": pd.array([None] * len(touched), "Int64").tolist() + ids[b[span]].tolist(),
            "n": np.concatenate([n[touched], np.zeros(len(span))]).astype(np.int64),
        }).astype({"other": "Int64"})

    found = materialise(full.groupBy("size", "t", "bundle", "a_slot", "a_part", "b_slot", "b_part").applyInPandas(compare, "vec_id bigint, other bigint, n bigint"), "links")
    for p in (path, slots_path):
        discard(spark, p)
    return found


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding).

    Vectors link at a cosine of at least ``cosine`` in double precision, all that are linked and found. Null and zero
    vectors and those with null or non-finite components link with nothing and are their own component; so are
    rows with a null vec_id, whose component and kept are null. Vectors of different sizes never link. Rows that repeat a vec_id are one
    node, and count each as another vector.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    good = (
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & (square > 0)
        & (square < float("inf"))
    )
    sound = rows.where(good)
    distinct = materialise(sound.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")).select("vec_id", "embedding", "copies"), "distinct")
    found = linked(distinct, cosine, recall, tile)
    counts = found.where("other is null").groupBy("vec_id").agg(F.sum("n").alias("others"))
    reach = connected_components(found.where("other is not null").select(F.col("vec_id").alias("src"), F.col("other").alias("dst")))
    classes = (
        distinct.join(counts, "vec_id", "left")
        .join(reach, distinct.vec_id == reach.node, "left")
        .select("embedding", "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    )
    rows_in = distinct.agg(F.sum("copies")).first()[0] or 0
    joined = join_counted(sound, materialise(classes, "classes"), ["embedding"], rows_in, "copies").select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(rest).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
