"""The inverted-file index against a scan: recall, exact searches, odd vectors, large cells, appended rows."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.operators import retrieval
from graphloom.operators import vector_index as v
from graphloom.plans.scratch import scratch_path


def best(rows, q, k):
    """(id, score) of a scan in plain Python."""
    out = []
    for i, x in rows:
        if x is None or len(x) != len(q):
            continue
        x = np.array(x, float)
        norm = np.linalg.norm(x) * np.linalg.norm(q)
        out.append((i, min(1.0, max(0.0, float(x @ q) / norm)) if norm else 0.0))
    return sorted(out, key=lambda r: (-r[1], r[0]))[:k]


def same(got, want):
    assert [round(s, 9) for _, s in got] == [round(s, 9) for _, s in want]
    assert [i for i, s in got if s > want[-1][1] + 1e-9] == [i for i, s in want if s > want[-1][1] + 1e-9]


@pytest.fixture(scope="module")
def large(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    path = scratch_path(spark, "vectors")
    v.build_vector_index(e, path)
    return e, path


def test_recall_and_pruned_folders(spark, large):
    e, path = large
    x = np.array([r.embedding for r in e.orderBy("vec_id").collect()], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    score = x[::20] @ x.T
    want = {(20 * q, int(i)) for q in range(len(score)) for i in np.argsort(-score[q], kind="stable")[:10]}
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r.id) for r in v.search_many(queries, path, 10).collect()}
    assert v._probes(spark, path, None) < len(v._cells(spark, path))
    assert len(got & want) / len(want) >= 0.95
    assert {(r.query_id, r.id) for r in v.search_many(queries, path, 10, exact=True, tile=64).collect()} == want
    found = v.search_vectors(spark, path, x[3].tolist(), 10, probes=2)._jdf.queryExecution().executedPlan()
    assert re.search(r"PartitionFilters: \[[^]]*cell#\d+ IN", found.toString())


def test_exact_searches_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(z) for z in rng.normal(size=5)]) for k in range(200)]
    rows += [(300 + k, [1.0, 0.5, 0.0, 0.0, 0.0]) for k in range(120)]  # a cell of equal vectors
    rows += [(500, None), (501, []), (502, [0.0] * 5), (503, [1.0, 2.0]), (504, [0.0] * 5)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("cell", F.lit(9)).withColumn("angle", F.lit("x"))
    path = scratch_path(spark, "vectors")
    v.build_vector_index(table.where("vec_id % 2 = 0"), path, cells=7)
    v.add_vectors(table.where("vec_id % 2 = 1"), path)
    assert spark.read.parquet(f"{path}/vectors").count() == len(rows)
    asked = [rows[0][1], rows[17][1], [1.0, 0.4, 0.0, 0.0, 0.1], [-3.0, 0.0, 0.0, 0.0, 0.0], [0.0] * 5, [1.0, 2.0]]
    for q in asked:
        for k in (3, 60, 1000):
            same([tuple(r) for r in v.search_vectors(spark, path, q, k, probes=1, exact=True).collect()], best(rows, np.array(q), k))
    many = spark.createDataFrame([(k, q) for k, q in enumerate(asked)] + [(90, None)], "query_id int, embedding array<double>")
    for k in (5, 150):
        got = v.search_many(many, path, k, probes=1, exact=True, tile=16).orderBy("query_id", F.desc("score"), "id").collect()
        for n in range(4):
            same([(r.id, r.score) for r in got if r.query_id == n], best(rows, np.array(asked[n]), k))
        assert {r.query_id for r in got} == {0, 1, 2, 3}


def test_small_and_empty_indexes(spark):
    path = scratch_path(spark, "vectors")
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    v.build_vector_index(none, path)
    assert v.search_vectors(spark, path, [1.0, 0.0], 3).count() == 0
    assert v.search_many(spark.createDataFrame([(1, [1.0])], "query_id int, embedding array<float>"), path, 3).count() == 0
    v.build_vector_index(spark.createDataFrame([(7, [0.0, 2.0])], "vec_id bigint, embedding array<float>"), path)  # replaced
    assert [tuple(r) for r in v.search_vectors(spark, path, [0.0, 1.0], 3).collect()] == [(7, 1.0)]
    assert v.search_vectors(spark, path, [], 3).count() == retrieval.knn(none, [], 3).count() == 0


def test_routes_are_handed_on_in_parts(spark):
    """A batch of queries that goes to very many cells is never copied for all of them at once."""
    from pyspark.sql import Row

    turns = np.linspace(0, np.pi, 300)
    cells = [Row(cell=k, centre=[float(np.cos(a)), float(np.sin(a))], rows=1, radius=0.0) for k, a in enumerate(turns)]
    asked = spark.createDataFrame([(k, [1.0, k / 200]) for k in range(200)], "query_id bigint, embedding array<double>").coalesce(1)
    routed = v._routed(asked, cells, 250, False)
    sizes = routed.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in batches), "n bigint")
    assert max(r.n for r in sizes.collect()) <= v._HANDED
    assert {(r.query_id, r.n) for r in routed.groupBy("query_id").agg(F.countDistinct("cell").alias("n")).collect()} == {(k, 250) for k in range(200)}
