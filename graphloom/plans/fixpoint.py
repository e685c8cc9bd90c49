"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import discard, materialise_at
from graphloom.plans.spread import spread


def _contract(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over rows (a, b) with a > b.

    Minima are taken by partial aggregation and joined back, so no node's
    neighbours are ever gathered in one row or task.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(low, "a")
    return (
        joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(joined.select("a", F.col("m").alias("b")))
        .where("a > b")
        .distinct()
    )


#: Edges up to which they are contracted as they are.
DIRECT = 2_000_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", direct: int = DIRECT) -> DataFrame:
    """(node, component): every node that an edge touches with its component's smallest node.

    Null endpoints and self loops join nothing. Each round writes its edges to the
    shared folder and drops the round before; rounds grow with the logarithm of
    the diameter. An empty edge table gives an empty result. Of more than ``direct`` edges
    only each node's to its smallest neighbour, fewer than there are nodes, go through
    the rounds; the other edges then lead between what these have joined, which is little.
    """
    spark = edges.sparkSession
    pairs = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
    every, every_path = materialise_at(pairs, "pairs")
    many = every.count()
    if many <= direct:
        found = _contracted(every)
        discard(spark, every_path)
        return found
    ends = every.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.*")
    hooks, hooks_path = materialise_at(ends.groupBy("x").agg(F.min("y").alias("y")).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")), "hooks")
    joined, _ = materialise_at(_contracted(hooks), "joined")
    of = lambda end, name: spread(joined.select(F.col("node").alias(end), F.col("component").alias(name)), many, end)
    left = spread(spread(every, many, "a").join(of("a", "ca"), "a").select("ca", "b"), many, "b").join(of("b", "cb"), "b").where("ca <> cb")
    rest, _ = materialise_at(left.select(F.greatest("ca", "cb").alias("a"), F.least("ca", "cb").alias("b")).distinct(), "rest")
    for path in (every_path, hooks_path):
        discard(spark, path)
    higher = _contracted(rest).select(F.col("node").alias("component"), F.col("component").alias("top"))
    return joined.join(higher, "component", "left").select("node", F.coalesce("top", "component").alias("component"))


def _contracted(pairs: DataFrame) -> DataFrame:
    """(node, component) of rows (a, b) with a > b, repeated ones too."""
    spark = pairs.sparkSession
    now, path = materialise_at(pairs.distinct(), "components")
    seal = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seal or mark.n == 0:
            break
        seal = mark
        after, after_path = materialise_at(_contract(now), "components")
        discard(spark, path)
        now, path = after, after_path
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
