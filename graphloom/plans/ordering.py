"""Running values along an order, and pointers to their ends, with no task that holds a whole group.

Rows are sorted into ranges of (group, order) once. What a window then sees is one group's rows in one range; a group that spans several ranges
takes the sums of the ranges before it, and of such groups a range has two at most, its first and its last.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.scratch import materialise_at


class Ordered:
    """``rows`` sorted by ``order`` within groups ``by``, in a written table with a column ``_block``; ``order`` tells a group's rows apart."""

    def __init__(self, rows: DataFrame, by: list[str], order: list[str], spent: list[str]):
        self.by, self.order = by, order
        keys = [*by, *order]
        self.rows, path = materialise_at(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_block", F.spark_partition_id()), "ordered")
        spent.append(path)
        key = F.struct(*by)
        ends = self.rows.groupBy("_block").agg(F.min(key).alias("low"), F.max(key).alias("high")).orderBy("_block").collect()  # a row per range
        spanning = {y.low for x, y in zip(ends, ends[1:], strict=False) if x.high == y.low}
        schema = T.StructType([T.StructField(f"_{f.name}", f.dataType) for f in self.rows.select(*by).schema])
        self.shared = self.rows.sparkSession.createDataFrame(list(map(tuple, spanning)), schema) if spanning else None

    def before(self, rows: DataFrame, values: dict[str, Column], how: Callable[[Column], Column] = F.sum, start=0) -> DataFrame:
        """``rows``, all or some of ``self.rows`` with other columns changed, and per name its value over the rows before each in its group; ``start`` where there is none."""
        earlier = Window.partitionBy(*self.by, "_block").orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1)
        out = rows.withColumns({n: how(c).over(earlier) for n, c in values.items()})
        if self.shared is not None:
            on = lambda right: reduce(lambda x, y: x & y, [rows[c].eqNullSafe(right[f"_{c}"]) for c in self.by])
            shared = F.broadcast(self.shared)
            part = rows.join(shared, on(self.shared), "left_semi").groupBy(*[F.col(c).alias(f"_{c}") for c in self.by], F.col("_block").alias("_range")).agg(*[how(c).alias(f"_v_{n}") for n, c in values.items()])
            ranges = Window.partitionBy(*[f"_{c}" for c in self.by]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range of a group
            part = part.select(*[f"_{c}" for c in self.by], "_range", *[how(f"_v_{n}").over(ranges).alias(f"_v_{n}") for n in values])
            same = reduce(lambda x, y: x & y, [out[c].eqNullSafe(part[f"_{c}"]) for c in self.by]) & (out["_block"] == part["_range"])
            both = lambda n: F.when(F.col(n).isNull(), F.col(f"_v_{n}")).when(F.col(f"_v_{n}").isNull(), F.col(n)).otherwise(F.col(n) + F.col(f"_v_{n}") if how is F.sum else F.greatest(n, f"_v_{n}"))
            out = out.join(F.broadcast(part), same, "left").withColumns({n: both(n) for n in values}).drop(*[f"_{c}" for c in self.by], "_range", *[f"_v_{n}" for n in values])
        return out if start is None else out.withColumns({n: F.coalesce(F.col(n), F.lit(start)) for n in values})


#: Rows that a task can number.
_ROWS = 1 << 33


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with their ``place`` in ``order``, from 1, which tells them apart: sorted into ranges once, a range's rows count behind those of the ranges before it."""
    sorted_, _ = materialise_at(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    block = F.floor(F.col("_at") / _ROWS).cast("bigint")
    sizes = sorted_.groupBy(block.alias("_block")).agg(F.count("*").alias("n")).orderBy("_block").collect()  # a row per range
    begins, at = [], 1
    for r in sizes:
        begins.append((r._block, at))
        at += r.n
    begin = rows.sparkSession.createDataFrame(begins, "_block bigint, _begin bigint")
    found = sorted_.withColumn("_block", block).join(F.broadcast(begin), "_block")
    return found.withColumn("place", F.col("_begin") + F.pmod(F.col("_at"), F.lit(_ROWS))).drop("_at", "_block", "_begin")


def first_untaken(pairs: DataFrame, spent: list[str]) -> DataFrame:
    """(source_id, node): who is taken where, in order, each node of ``pairs`` (source_id, left, right; left < right) not yet taken takes its right ones.

    All nodes that no open pair has at its right can't be taken any more, so they take theirs at once; pairs of either end. Rounds grow with the
    longest chain of choices that rest on each other, which is short unless pairs form a line in order. No source is held in a task.
    """
    open_, path = materialise_at(pairs.select("source_id", "left", "right").distinct(), "open")
    spent.append(path)
    taken = []
    while True:
        rights = open_.select("source_id", F.col("right").alias("left"))
        free = open_.select("source_id", "left").distinct().join(rights, ["source_id", "left"], "left_anti")
        now, path = materialise_at(open_.join(free, ["source_id", "left"]).select("source_id", F.col("right").alias("node")).distinct(), "taken")
        spent.append(path)
        taken.append(now)
        if now.isEmpty():
            return reduce(DataFrame.unionByName, taken)
        rest = open_.join(now.withColumnRenamed("node", "right"), ["source_id", "right"], "left_anti").join(now.withColumnRenamed("node", "left"), ["source_id", "left"], "left_anti")
        open_, path = materialise_at(rest, "open")  # pairs of those who took are gone with what they took
        spent.append(path)


def pointer_ends(pointers: DataFrame, spent: list[str]) -> DataFrame:
    """(source_id, node, end) of ``pointers`` (source_id, node, to) without cycles: the last of each chain, found by doubling."""
    now, path = materialise_at(pointers.select("source_id", "node", F.col("to").alias("end")), "pointers")
    spent.append(path)
    while True:
        x, y = now.alias("x"), now.alias("y")
        step = x.join(y, (F.col("x.source_id") == F.col("y.source_id")) & (F.col("x.end") == F.col("y.node")), "left")
        after, path = materialise_at(step.select("x.source_id", "x.node", F.coalesce("y.end", "x.end").alias("end"), F.col("y.end").isNotNull().alias("moved")), "pointers")
        spent.append(path)
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now
