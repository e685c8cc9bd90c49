"""Spanning forests and sums over the parts of trees, in rounds that grow with the logarithm of the graph, whatever its depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.ordering import pointer_ends
from graphloom.plans.scratch import discard, materialise_at

_BUCKETS = 64


def spanning_forest(pairs: DataFrame) -> DataFrame:
    """(a, b): those of ``pairs`` (a, b; each pair once, a < b) that span each component without a cycle.

    Every part takes its least edge by a hash, so the edges taken close no cycle but that of two parts that take the same one; parts are named by
    pointer doubling and edges inside a part dropped. Each round at least halves the parts that still have edges.
    """
    spark = pairs.sparkSession
    weight = F.struct(F.xxhash64("a", "b").alias("h"), "a", "b").alias("edge")
    now, path = materialise_at(pairs.select(weight, F.col("a").alias("x"), F.col("b").alias("y")), "parts")
    taken, taken_paths = [], []
    while not now.isEmpty():
        spent: list[str] = [path]
        both = now.select(F.explode(F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y")), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e"), "edge").select("e.*", "edge")
        pick, pick_path = materialise_at(both.groupBy("x").agg(F.min(F.struct("edge", "y")).alias("pick")).select("x", "pick.y", "pick.edge"), "picks")
        spent.append(pick_path)
        chosen, chosen_path = materialise_at(pick.select("edge.a", "edge.b").distinct(), "forest")
        taken.append(chosen)
        taken_paths.append(chosen_path)
        # of two parts that took the same edge the smaller is the root
        mutual = pick.select(F.col("x").alias("y"), F.col("y").alias("back"))
        to = pick.join(mutual, "y", "left").where(~((F.col("back") == F.col("x")) & (F.col("x") < F.col("y")))).select(F.lit(0).alias("source_id"), F.col("x").alias("node"), F.col("y").alias("to"))
        ends = pointer_ends(to, spent).select("node", "end")
        name = lambda c: ends.select(F.col("node").alias(c), F.col("end").alias(f"_{c}"))  # noqa: B023, E731
        named = now.join(name("x"), "x", "left").join(name("y"), "y", "left").select("edge", F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y")).where("x <> y")
        least = named.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("edge").alias("edge"))  # of parallel edges only the least can be taken
        now, path = materialise_at(least, "parts")
        for p in spent:
            discard(spark, p)
    discard(spark, path)
    out = pairs.limit(0).select("a", "b")
    for t in taken:
        out = out.unionByName(t)
    return out


def cut_sums(forest: DataFrame, marks: DataFrame) -> DataFrame:
    """(a, b, h, g) of each edge of ``forest``: the exclusive or of ``marks`` (id, h, g) on one side of it, where all marks of a tree cancel out.

    Each tree is walked around its edges: after an arc into a node follows the arc to that node's next neighbour, so the walk is a list of arcs, and what lies behind an edge is a stretch of
    it. A node's mark stands at its first outgoing arc; sums to the end of the list are found by pointer doubling.
    """
    spark, spent = forest.sparkSession, []
    arcs = forest.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
    # a node's neighbours in a circle: bucket by bucket, so that a hub's are sorted in many tasks
    zero = F.lit(0).cast("bigint")
    arcs, path = materialise_at(arcs.withColumn("bucket", F.pmod(F.xxhash64("v"), F.lit(_BUCKETS))), "around")
    spent.append(path)
    buckets = arcs.groupBy("u", "bucket").agg(F.min("v").alias("head"))
    node = Window.partitionBy("u").orderBy("bucket")  # a row per bucket
    buckets = buckets.select("u", "bucket", F.coalesce(F.lead("head").over(node), F.first("head").over(node)).alias("then"), (F.row_number().over(node) == 1).alias("leads"))
    within = Window.partitionBy("u", "bucket").orderBy("v")
    sorted_ = arcs.select("u", "bucket", "v", F.lead("v").over(within).alias("after"), (F.row_number().over(within) == 1).alias("heads"))
    circled = sorted_.join(buckets, ["u", "bucket"]).select("u", "v", F.coalesce("after", "then").alias("after"), (F.col("heads") & F.col("leads")).alias("first"))
    own = circled.join(marks.select(F.col("id").alias("u"), "h", "g"), "u", "left")
    first = F.col("first")
    arc = F.struct("u", "v")
    # the arc (v, u) is followed by (u, the neighbour of u after v)
    listed = own.select(F.struct(F.col("v").alias("u"), F.col("u").alias("v")).alias("arc"), F.struct(F.col("u").alias("u"), F.col("after").alias("v")).alias("next"))
    valued = own.select(arc.alias("arc"), F.when(first, F.coalesce("h", zero)).otherwise(zero).alias("h"), F.when(first, F.coalesce("g", zero)).otherwise(zero).alias("g"))
    base, path = materialise_at(listed.join(valued, "arc"), "arcs")
    spent.append(path)
    # a tree's list is cut behind its least arc in a component's walk: its arcs are a circle, of which the least arc seen by doubling minima is the end
    now, path = materialise_at(base.select("arc", "next", F.least("arc", "next").alias("low")), "circles")
    spent.append(path)
    while True:
        ahead = now.select(F.col("arc").alias("next"), F.col("next").alias("_next"), F.col("low").alias("_low"))
        step = now.join(ahead, "next").select("arc", F.col("_next").alias("next"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("moved"))
        step, path = materialise_at(step, "circles")
        spent.append(path)
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    ends = now.where("arc = low").select("arc", F.lit(True).alias("end"))
    sums, path = materialise_at(base.join(ends, "arc", "left").select("arc", F.when(F.col("end").isNull(), F.col("next")).alias("next"), "h", "g"), "sums")
    spent.append(path)
    while not sums.where("next is not null").isEmpty():
        ahead = sums.select(F.col("arc").alias("next"), F.col("next").alias("_next"), F.col("h").alias("_h"), F.col("g").alias("_g"))
        step = sums.join(ahead, "next", "left").select("arc", F.col("_next").alias("next"), F.col("h").bitwiseXOR(F.coalesce("_h", zero)).alias("h"), F.col("g").bitwiseXOR(F.coalesce("_g", zero)).alias("g"))
        sums, path = materialise_at(step, "sums")
        spent.append(path)
    # behind an edge lies what the list holds after its one arc up to its other one
    rest = sums.join(base.select("arc", F.col("h").alias("own_h"), F.col("g").alias("own_g")), "arc")
    rest = rest.select(F.least("arc.u", "arc.v").alias("a"), F.greatest("arc.u", "arc.v").alias("b"), F.col("h").bitwiseXOR(F.col("own_h")).alias("h"), F.col("g").bitwiseXOR(F.col("own_g")).alias("g"))
    out, _ = materialise_at(rest.groupBy("a", "b").agg(F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g")), "cuts")
    for p in spent:
        discard(spark, p)
    return out
