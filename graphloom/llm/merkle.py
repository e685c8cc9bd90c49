"""Merkle manifest of a dataset: trees of arity three per source and over the sources, and a proof for each row.

A level of a tree is hashed with lag and lead columns at fixed offsets: masked by a node's slot in its run of three and by the run's
length they are the node's siblings, and each run's first child hashes its parent. Windows run over blocks of
``3 ** DEPTH`` nodes, never over a whole source: a source with a third of all rows is as many tasks' work as its rows need. Within a block all
levels share one sort, a node standing in the row of its first leaf, where the level's siblings are ``3 ** level`` rows away. The
blocks' top nodes are the next round's leaves, so rounds grow with the logarithm of the largest source.

Proofs are put together from the top down: a block's rows take the path above it once, by a join with one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import rows_of
from graphloom.plans.scratch import discard, materialise_at

#: Children of a node, and levels that one round hashes: blocks have ``ARITY ** DEPTH`` rows.
ARITY, DEPTH = 3, 6
BLOCK = ARITY**DEPTH

_SIBLINGS = "struct<left:string,right:string>"


def _field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered): each row's digest, and that of the row without line breaks in its text where that is tried and changes it, else null."""
    rows = rows_of(docs, "doc_id", "source", "lang", "n_chars", "text")
    digest = lambda text: F.sha2(F.concat(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _field(text)), 256)
    tried = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.col("text").contains("\n")
    return rows.select("doc_id", "source", digest(F.col("text")).alias("leaf"), F.when(tried, digest(F.translate("text", "\n", ""))).alias("tampered"))


def _numbered(rows: DataFrame, order: list[Column], tag: str) -> tuple[DataFrame, str]:
    """``rows`` in a written table with ``task`` and ``place``: their places from 0 in ``order``, which no single task sorts.

    Ranges of the order are sorted apart; a place is its range's rows before it and those of the ranges before. There is one
    number for each range, so these are summed up in one small window.
    """
    mark = F.monotonically_increasing_id()
    sorted_, path = materialise_at(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mark", mark), tag)
    sorted_ = sorted_.withColumn("task", F.shiftright("mark", 33))
    ranges = sorted_.groupBy("task").agg(F.count("*").alias("rows"))
    starts = ranges.select("task", (F.sum("rows").over(Window.orderBy("task")) - F.col("rows")).alias("start"))
    return sorted_.join(F.broadcast(starts), "task").withColumn("place", F.col("start") + F.col("mark").bitwiseAND((1 << 33) - 1)).drop("mark", "start"), path


def _blocked(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A round over ``nodes`` (g, i, n, d, anything else): node i of the n of group g, from 0.

    Gives the nodes with ``path``, an array of their siblings level by level inside the block, and the blocks' tops as nodes (g, i, n, d).
    A run of one has no siblings and is hashed all the same; a group's single node is its root.
    """
    block = F.expr(f"i div {BLOCK}")
    w = Window.partitionBy("g", "block").orderBy("i")
    now = nodes.withColumn("block", block).withColumn("d0", F.col("d"))
    for level in range(DEPTH):
        step, d = ARITY**level, f"d{level}"
        before, after = F.lag(d, step).over(w), F.lead(d, step).over(w)
        now = now.withColumns({"before1": before, "before2": F.lag(d, 2 * step).over(w), "after1": after, "after2": F.lead(d, 2 * step).over(w)})
        nodes_here = F.ceil(F.col("n") / step)
        at = F.expr(f"i div {step}")
        slot = at % ARITY
        length = F.least(F.lit(ARITY), nodes_here - at + slot)  # of this node's run
        hashed = (F.col("i") % step == 0) & (nodes_here > 1)
        none = F.lit("")
        left = F.concat(F.when(slot == 2, F.col("before2")).otherwise(none), F.when(slot >= 1, F.col("before1")).otherwise(none))
        right = F.concat(F.when(slot + 1 < length, F.col("after1")).otherwise(none), F.when(slot + 2 < length, F.col("after2")).otherwise(none))
        now = now.withColumn(f"s{level}", F.when(hashed, F.struct(left.alias("left"), right.alias("right"))))
        first = F.col("i") % (step * ARITY) == 0
        parent = F.when(nodes_here > 1, F.sha2(F.concat(F.col(d), F.col(f"s{level}.right")), 256)).otherwise(F.col(d))
        now = now.withColumn(f"d{level + 1}", F.when(first, parent))
    # each level's siblings stand in the first leaf of their node: the last ones seen are a row's own
    own = [F.last(f"s{level}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for level in range(DEPTH)]
    path = F.filter(F.array(*own), lambda s: s.isNotNull())
    tops = now.where(F.col("i") % BLOCK == 0).select("g", F.col("block").alias("i"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col(f"d{DEPTH}").alias("d"))
    return now.select(*nodes.columns, "block", path.alias("path")), tops


def climbed(nodes: DataFrame, most: int, spent: list[str]) -> list[DataFrame]:
    """Rounds of nodes from ``nodes`` to one node per group, its root; ``most`` is the largest n. Later rounds are written tables."""
    rounds = [nodes]
    while most > 1:
        tops, path = materialise_at(_blocked(rounds[-1])[1], "tree")
        spent.append(path)
        rounds.append(tops)
        most = -(-most // BLOCK)
    return rounds


def _with_path(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` with their whole path: that inside the block and the block's own, from ``above`` (g, block, upper, anything else)."""
    inside, _ = _blocked(nodes)
    return inside.join(above, ["g", "block"]).withColumn("path", F.concat("path", "upper")).drop("block", "upper")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered, subroot, root, path) of each row; ``path`` holds its siblings, left and right, from leaf to root.

    A source's leaves stand by doc_id (null first), rows of one id by digest; sources by their bytes, null first and a source like any
    other. An empty table has an empty manifest. Extra columns don't matter.
    """
    spark, spent = docs.sparkSession, []

    def held(df: DataFrame, tag: str) -> DataFrame:
        table, path = materialise_at(df, tag)
        spent.append(path)
        return table

    # hashed once: sorting into ranges reads its input twice
    hashed = held(leaves(docs), "hashed")
    placed, rows_path = _numbered(hashed, [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()], "leaves")
    # a source's stretch within one sorted range: as many rows as sources and ranges, whatever a source's size
    stretches = held(placed.groupBy("task", "source").agg(F.min("place").alias("low"), F.count("*").alias("rows")), "stretches")
    source = Window.partitionBy("source")
    whole = stretches.select("task", "source", "low", F.min("low").over(source).alias("first"), F.sum("rows").over(source).alias("n"))
    firsts, firsts_path = _numbered(whole.where("low = first").select("first", "n"), [F.col("first").asc()], "sources")
    spent.append(firsts_path)
    stats = firsts.agg(F.count("*").alias("sources"), F.max("n").alias("most")).first()
    known = whole.join(firsts.select("first", F.col("place").alias("g")), "first").select("task", F.col("source").alias("of"), "first", "n", "g")
    p, k = placed.alias("p"), known.alias("k")
    numbered = p.join(k, (F.col("p.task") == F.col("k.task")) & F.col("p.source").eqNullSafe(F.col("k.of"))).select(
        "k.g", (F.col("p.place") - F.col("k.first")).alias("i"), "k.n", F.col("p.leaf").alias("d"), "p.doc_id", "p.source", "p.tampered"
    )
    nodes, _ = materialise_at(numbered, "nodes")
    discard(spark, rows_path)
    trees = climbed(nodes, stats.most or 0, spent)
    subroots = trees[-1].select(F.lit(0).cast("bigint").alias("g"), F.col("g").alias("i"), F.lit(stats.sources).cast("bigint").alias("n"), "d")
    top = climbed(subroots, stats.sources, spent)
    root = getattr(top[-1].first(), "d", None)
    above = top[-1].select("g", F.col("i").alias("block"), F.array().cast(f"array<{_SIBLINGS}>").alias("upper"))
    for tree in reversed(top[:-1]):
        above = held(_with_path(tree, above).select("g", F.col("i").alias("block"), F.col("path").alias("upper"), *(["d"] if tree is subroots else [])), "paths")
    if len(top) == 1:
        above = above.join(subroots.select("g", F.col("i").alias("block"), "d"), ["g", "block"])
    # a source's root is the single node of its last round, in block 0 of what is above it
    above = above.select(F.col("block").alias("g"), F.lit(0).cast("bigint").alias("block"), "upper", F.col("d").alias("subroot"))
    for tree in reversed(trees[1:-1]):
        above = held(_with_path(tree, above).select("g", F.col("i").alias("block"), F.col("path").alias("upper"), "subroot"), "paths")
    above, _ = materialise_at(above, "above")
    for path in spent:
        discard(spark, path)
    whole = _with_path(nodes, above) if len(trees) > 1 else nodes.join(above.drop("block"), "g").withColumnRenamed("upper", "path")
    return whole.select("doc_id", "source", F.col("d").alias("leaf"), "tampered", "subroot", F.lit(root).cast("string").alias("root"), "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    folded_root is folded from the row as it is found at checking: without line breaks where the CRC-32 of doc_id is even.
    Such a row is verified only if it had none. A row without an id isn't tampered with.
    """
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    checked = manifest(docs).select(
        "doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root")
    )
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))
