"""Choices in order, made in parallel, against plain loops: large groups over several ranges, ties, nulls; tiles against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_extraction import limited_by_loop

from graphloom.operators import extraction, resolution
from graphloom.plans.ordering import Ordered, first_untaken, pointer_ends


@pytest.fixture(params=["together", "apart"])
def ranges(request, spark):
    """Ranges as they are sorted, or merged into one as for small tables."""
    spark.conf.set("spark.sql.adaptive.enabled", request.param == "together")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    yield request.param
    spark.conf.set("spark.sql.adaptive.enabled", True)
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_running_values(spark, ranges):
    pick = random.Random(1)
    rows = [(pick.choice([None, "a", "a", "a", "a", "b", "c"]), k, pick.randint(0, 5)) for k in range(500)]
    spent = []
    order = Ordered(spark.createDataFrame(rows, "g string, k bigint, v int"), ["g"], ["k"], spent)
    got = {r.k: (r.total, r.most) for r in order.before(order.before(order.rows, {"total": F.col("v")}), {"most": F.when(F.col("v") < 5, F.col("k"))}, F.max, start=None).collect()}
    total, most, want = defaultdict(int), {}, {}
    for g, k, v in rows:
        want[k] = (total[g], most.get(g))
        total[g] += v
        if v < 5:
            most[g] = k
    assert got == want and (order.shared is not None) == (ranges == "apart")


@pytest.mark.parametrize(("degree", "same", "ratio", "protect"), [(3, 2, 1.0, True), (3, 2, 9.0, False), (1, 1, 0.4, True), (2, 50, 100.0, True), (0, 3, 2.0, True), (25, 12, 8.0, False)])
def test_limits_of_hubs(spark, ranges, degree, same, ratio, protect):
    """A source of hubs and a small one; confidences tie, some are unknown, ends may be equal or missing."""
    pick = random.Random(degree + same)
    rows = []
    for source, nodes, n in ((1, 40, 400), (2, 5, 30)):
        for k in range(n):
            end = lambda: pick.choice([0, 0, 1, None, *range(nodes)])  # noqa: B023, E731
            rows.append((source, k, end(), end(), pick.choice(["x", "y", None]), pick.choice([0.1, 0.5, 0.5, 0.9, None])))
    relations = spark.createDataFrame(rows, "source_id bigint, ordinal bigint, source bigint, target bigint, type string, confidence double")
    entities = spark.range(46).select(F.when(F.col("id") < 40, 1).otherwise(2).alias("source_id"))
    got = {(r.source_id, r.ordinal): r.outcome for r in extraction.limited(relations, entities, degree, same, ratio, protect).collect()}
    for source, n in ((1, 40), (2, 6)):
        mine = [(o, a, b, t, -1.0 if c is None else c) for s, o, a, b, t, c in rows if s == source]
        assert {o: v for (s, o), v in got.items() if s == source} == limited_by_loop(mine, n, degree, same, ratio, protect)


def test_greedy_takers_and_chains(spark, ranges):
    pick = random.Random(3)
    pairs = sorted({(s, *sorted(pick.sample(range(60), 2))) for s in (1, 2) for _ in range(150)})
    taken = set()
    for s, a, b in pairs:
        if (s, a) not in taken:
            taken.add((s, b))
    assert {tuple(r) for r in first_untaken(spark.createDataFrame(pairs, "source_id bigint, left bigint, right bigint"), []).collect()} == taken
    to = {k: pick.randint(k + 1, 99) for k in range(98)} | {98: 99}
    end = {k: 99 for k in to}
    assert {r.node: r.end for r in pointer_ends(spark.createDataFrame([(1, k, v) for k, v in to.items()], "source_id bigint, node bigint, to bigint"), []).collect()} == end


def test_merged_confidence(spark, ranges):
    """Many merges into one entity, with and without losses."""
    pick = random.Random(8)
    n = 120
    sure = [pick.random() for _ in range(n)]
    pairs = [(1, a, b, pick.choice([0.5, 0.52, 0.9])) for a in (0, 1, 2) for b in range(a + 1, n) if pick.random() < 0.7]
    taken, merged = {}, list(sure)
    for _, a, b, score in pairs:
        if a not in taken and b not in taken:
            taken[b] = a
            merged[a] = max(0.1, max(merged[a], sure[b]) - (0.05 if score - 0.5 < 0.10 else 0.0))
    e = spark.createDataFrame([(1, k, c) for k, c in enumerate(sure)], "source_id bigint, ordinal bigint, confidence double")
    got = {r.ordinal: (r.canonical, r.confidence) for r in resolution.greedy_merge(spark.createDataFrame(pairs, "source_id bigint, left bigint, right bigint, score double"), e, 0.5).collect()}
    assert got == {k: (taken.get(k, k), pytest.approx(merged[k])) for k in range(n)}


def test_hierarchy_of_many_names(spark, ranges):
    """Names of two words over few words: chains, cycles of choices, ties."""
    pick = random.Random(5)
    words = ["ann", "bob", "cox", "dee", "annbob"]
    names = [" ".join(pick.sample(words, pick.randint(1, 3))) for _ in range(80)]
    e = spark.createDataFrame([(1, k, n, "P") for k, n in enumerate(names)], "source_id bigint, ordinal bigint, name string, type string")
    keep = {(r.left, r.right): r.canonical for r in resolution.name_pairs(e).collect()}
    into = {}
    for a in range(80):
        if a not in into:
            for b in range(a + 1, 80):
                if b not in into and (a, b) in keep:
                    into[b if keep[a, b] == a else a] = into.get(keep[a, b], keep[a, b])
    def root(x):
        return root(into[x]) if x in into else x
    assert {r.ordinal: r.canonical for r in resolution.hierarchical(e).collect()} == {k: root(k) for k in range(80)}


def vectors(n, size=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 8), size))
    return (centres[rng.integers(0, len(centres), n)] + 0.4 * rng.normal(size=(n, size))).astype(np.float32)


def test_tiles_of_a_large_group(spark):
    """20,000 vectors of one source in tiles of 1,024: every pair that a full product has, none twice."""
    x = vectors(20_000)
    rows = spark.createDataFrame([(1, k, v.tolist()) for k, v in enumerate(x)], "source_id bigint, ordinal bigint, embedding array<float>").repartition(8)
    got = resolution.near_pairs(rows, 0.95).toPandas()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = set()
    for a in range(0, len(u), 2000):
        i, j = np.nonzero(u[a : a + 2000] @ u.T >= 0.95)
        want |= {(int(p) + a, int(q)) for p, q in zip(i, j, strict=True) if p + a < q}
    assert len(got) == len(want) and set(zip(got.left.tolist(), got.right.tolist(), strict=True)) == want and len(want) > 500


def test_similar_pairs_in_small_tiles(spark):
    """Both sides of the switch to equal types, groups of types, odd vectors; tiles of seven rows."""
    x = vectors(90, 6, 2)
    names, kinds = ["Ann", "ann ", "Bob", None], ["Person", "character", "Thing", None, "Place"]
    rows = [(1 if k < 60 else 2, k, names[k % 4], kinds[k % 5], [names[(k * 7) % 3], f"n{k % 6}", None] if k % 3 else None, v.tolist()) for k, v in enumerate(x)]
    rows += [(2, 100, "Ann", "Person", [], None), (2, 101, "Ann", "Person", [], [1.0, 2.0]), (2, 102, "Ann", "Person", [], [0.0] * 6), (2, 103, "Ann", "Person", [], [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    e = spark.createDataFrame(rows, "source_id bigint, ordinal bigint, name string, type string, aliases array<string>, embedding array<float>")
    groups = {"people": ["PERSON", "Character"]}
    want = {}
    for a in rows:
        for b in rows:
            if a[0] != b[0] or a[1] >= b[1] or a[5] is None or b[5] is None or len(a[5]) != len(b[5]) or None in a[5] + b[5]:
                continue
            s, t = ((v[3] or "unknown").lower() for v in (a, b))
            if not (s == t or (a[0] == 2 and (s in ("thing", "unknown") or t in ("thing", "unknown") or {s, t} == {"person", "character"}))):
                continue
            norm = np.linalg.norm(np.float64(a[5])) * np.linalg.norm(np.float64(b[5]))
            base = float(np.float64(a[5]) @ np.float64(b[5]) / norm) if norm else 0.0
            key = lambda v: None if v is None else v.strip().lower()
            na, nb = key(a[2]), key(b[2])
            la, lb = ({key(v) for v in (y[4] or []) if v is not None} for y in (a, b))
            score = min(1.0, base + 0.2 * (na is not None and na == nb) + 0.15 * (na in lb) + 0.15 * (nb in la) + 0.1 * bool(la & lb))
            if score >= 0.5 and (score > base or score >= 0.58):
                want[a[1], b[1]] = pytest.approx(score)
    for tile in (7, 1024):
        got = {(r.left, r.right): r.score for r in resolution.similar_pairs(e, 0.5, partition_from=50, groups=groups, tile=tile).collect()}
        assert got == want
    assert len(want) > 100 and any(b >= 60 for _, b in want)
