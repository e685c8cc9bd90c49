"""A stored inverted-file index of vectors: cells around fitted centres, a folder per cell.

A search reads the folders of the cells nearest to its query and scores what is in them exactly. Each cell knows the largest angle between its
centre and its vectors, so no vector of a cell can be closer to the query than the centre's angle less that: ``exact`` then reads the cells that may
still hold one of the best k, which gives what a scan of everything gives.

Centres are fitted on a sample of about ``MOST_FITTING`` vectors, every vector is indexed. How many cells a search that isn't exact reads is measured: as many as hold ``RECALL``
of the best ten of ``ASKED`` stored vectors. Zero, null, non-finite and other-sized ones lie in a cell of their own, which every search reads.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import model as m
from graphloom.catalog import query
from graphloom.operators.retrieval import knn
from graphloom.operators.tiles import TILE, per_tile, unit_rows
from graphloom.plans.scratch import materialise, scratch_path

#: Vectors that centres are fitted on, about; cells at most, so that all centres are one small matrix.
MOST_FITTING, MOST_CELLS = 100_000, 4096
#: Vectors whose neighbours tell how many cells to read, and the share of these that must be in them.
ASKED, RECALL = 256, 0.97
#: The cell of vectors that have no direction.
ODD = -1
_AT_ONCE = 1024
#: Entries of a matrix of queries and cells, and rows of queries with their cells, that a task holds at a time.
_ROUTES, _HANDED = 1 << 20, 1 << 14


def _sound(size: int):
    x = F.col("embedding")
    plain = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(x) == size) & plain & F.exists(x, lambda v: v != 0), F.lit(False))


def _assigned(vectors: DataFrame, key: str, centres: np.ndarray) -> DataFrame:
    """(id, embedding, cell, angle): each vector with its nearest centre."""
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), _sound(centres.shape[1] if len(centres) else 0).alias("sound"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _AT_ONCE):
                part = pa.Table.from_batches([batch.slice(start, _AT_ONCE)])
                sound = part.column("sound").to_numpy()
                cell, angle = np.full(len(sound), ODD), np.zeros(len(sound))
                if sound.any():
                    near = unit_rows(part.filter(pa.array(sound)).column("embedding")) @ centres.T
                    cell[sound] = near.argmax(axis=1)
                    angle[sound] = np.arccos(np.clip(near.max(axis=1), -1.0, 1.0))
                yield pa.RecordBatch.from_arrays([part.column("id").combine_chunks(), part.column("embedding").combine_chunks(), pa.array(cell, pa.int32()), pa.array(angle)], ["id", "embedding", "cell", "angle"])

    return rows.mapInArrow(run, f"id {kind}, embedding array<double>, cell int, angle double")


def _written(vectors: DataFrame, path: str, key: str, centres: np.ndarray, mode: str) -> None:
    """Vectors in the folders of their cells, a large cell in several files, and what each cell got."""
    spark = vectors.sparkSession
    held = materialise(_assigned(vectors, key, centres), "assigned")
    held.repartitionByRange("cell", F.xxhash64("id")).write.mode(mode).partitionBy("cell").parquet(f"{path}/vectors")
    held.groupBy("cell").agg(F.count("*").alias("rows"), F.max("angle").alias("radius")).coalesce(1).write.mode(mode).parquet(f"{path}/cells")
    spark.catalog.refreshByPath(path)


def build_vector_index(vectors: DataFrame, path: str, key: str = "vec_id", cells: int | None = None, fitted_on: int = MOST_FITTING, seed: int = 7, recall: float = RECALL) -> None:
    """Write an index of ``vectors`` (key, embedding) to ``path``; one that is there is replaced.

    Its size is that of most vectors. ``cells`` defaults to the square root of their number.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sizes = vectors.where("size(embedding) > 0").groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    centres = np.zeros((0, 0))
    if sizes is not None:
        sound = vectors.where(_sound(sizes.size))
        n = sound.count()
        cells = min(cells or max(1, math.isqrt(n)), MOST_CELLS)
        share = F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * min(1.0, fitted_on / max(n, 1)))
        sample = sound.where(share).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
        if n and not sample.isEmpty():
            found = KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=15).fit(sample).clusterCenters() if cells > 1 else [_mean(sample)]
            centres = np.array(found)
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    spark = vectors.sparkSession
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    _written(vectors, path, key, centres, "overwrite")
    for measured in (1, None):  # searches need to know the id's type before cells can be measured
        facts = (vectors.schema[key].dataType.simpleString(), measured or _measured(spark, path, recall))
        spark.createDataFrame([facts], "kind string, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


def _measured(spark: SparkSession, path: str, recall: float, k: int = 10) -> int:
    """The least number of cells that hold ``recall`` of the best ``k`` of ``ASKED`` vectors, chosen by hash."""
    cells = [c for c in _cells(spark, path) if c.rows]
    rows = _rows(spark, path)
    asked = rows.where(F.col("cell") != ODD).orderBy(F.xxhash64("id"), "id").limit(ASKED).select(F.col("id").alias("query_id"), "embedding")
    if not cells or asked.isEmpty():
        return 1
    hits = search_many(asked, path, k, probes=len(cells))
    found = asked.join(hits, "query_id").join(rows.select("id", "cell"), "id").where(F.col("cell") != ODD).select("embedding", "cell").toPandas()  # ASKED * k rows
    to = _angles(np.array([e / np.linalg.norm(e) for e in found["embedding"]]), cells)[1]
    own = to[np.arange(len(to)), np.searchsorted([c.cell for c in cells], found["cell"])]
    places = np.sort((to < own[:, None]).sum(axis=1))
    return int(places[min(len(places) - 1, math.ceil(recall * len(places)))]) + 1


def _probes(spark: SparkSession, path: str, probes: int | None) -> int:
    return probes if probes is not None else spark.read.parquet(f"{path}/facts").first().probes


def _rows(spark: SparkSession, path: str) -> DataFrame:
    kind = spark.read.parquet(f"{path}/facts").first().kind
    return spark.read.schema(f"id {kind}, embedding array<double>, angle double, cell int").parquet(f"{path}/vectors")


def _mean(sample: DataFrame) -> np.ndarray:
    from pyspark.ml.stat import Summarizer

    return sample.select(Summarizer.mean(sample.features).alias("mean")).first().mean.toArray()


def add_vectors(vectors: DataFrame, path: str, key: str = "vec_id") -> None:
    """Append ``vectors`` to an index: each to its nearest cell; centres stay as they were fitted."""
    centres = np.array([r.centre for r in _cells(vectors.sparkSession, path) if r.centre is not None])
    _written(vectors, path, key, centres if len(centres) else np.zeros((0, 0)), "append")


def _cells(spark: SparkSession, path: str) -> list[Row]:
    """(cell, centre, rows, radius) of each cell, ``MOST_CELLS`` rows at most; cells that got nothing have no rows."""
    got = spark.read.parquet(f"{path}/cells").groupBy("cell").agg(F.sum("rows").alias("rows"), F.max("radius").alias("radius"))
    return spark.read.parquet(f"{path}/centres").join(F.broadcast(got), "cell", "left").orderBy("cell").collect()


def _angles(queries: np.ndarray, cells: list[Row]) -> np.ndarray:
    """The least angle that each cell's vectors can have to each query, and in [1] the angle to its centre."""
    to = np.arccos(np.clip(queries @ np.array([c.centre for c in cells]).T, -1.0, 1.0))
    return np.stack([np.maximum(0.0, to - np.array([c.radius for c in cells])), to])


def search_vectors(spark: SparkSession, path: str, query_vector: list[float], k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(id, score): the nearest by cosine, as :func:`knn` gives them, among the ``probes`` nearest cells (those measured when it was built), or with ``exact`` among all."""
    cells = [c for c in _cells(spark, path) if c.rows]
    q = np.array(query_vector, float)
    rows = _rows(spark, path)
    if not cells or len(q) != len(cells[0].centre) or not np.linalg.norm(q) > 0:
        return knn(rows, query_vector, k, key="id")
    probes = _probes(spark, path, probes)
    least, to = _angles(q[None] / np.linalg.norm(q), cells)[:, 0]
    chosen = {ODD, *(cells[j].cell for j in np.argsort(to, kind="stable")[:probes])}
    hits = knn(rows.where(F.col("cell").isin(*map(int, chosen))), query_vector, k, key="id")
    if not exact:
        return hits
    best = hits.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    if best.n < k or best.least <= 0:
        return knn(rows, query_vector, k, key="id")
    chosen |= {c.cell for c, a in zip(cells, least, strict=True) if math.cos(a) >= best.least - 1e-9}
    return knn(rows.where(F.col("cell").isin(*map(int, chosen))), query_vector, k, key="id")


def _routed(queries: DataFrame, cells: list[Row], probes: int, skip: bool) -> DataFrame:
    """Each query (query_id, embedding) with the cells that it reads: the nearest ones, or with ``skip`` (column ``bar``) those after them that may reach the bar."""
    kind = queries.schema["query_id"].dataType.simpleString()
    names = np.array([c.cell for c in cells], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = max(1, min(_AT_ONCE, _ROUTES // len(cells)))
        for batch in batches:
            for start in range(0, batch.num_rows, many):
                part = pa.Table.from_batches([batch.slice(start, many)])
                least, to = _angles(unit_rows(part.column("embedding")), cells)
                order = to.argsort(axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
                wanted = place < probes
                if skip:
                    wanted = ~wanted & (np.cos(least) >= part.column("bar").to_numpy()[:, None] - 1e-9)
                i, j = np.nonzero(wanted)
                for a in range(0, len(i), _HANDED):  # a query goes to so many cells that all its copies at once would be too much
                    taken = part.take(pa.array(i[a : a + _HANDED]))
                    yield pa.RecordBatch.from_arrays([taken.column("query_id").combine_chunks(), taken.column("embedding").combine_chunks(), pa.array(names[j[a : a + _HANDED]])], ["query_id", "embedding", "cell"])

    return queries.mapInArrow(run, f"query_id {kind}, embedding array<double>, cell int")


def _scored(routed: DataFrame, rows: DataFrame, counts: dict[int, int], k: int, tile: int) -> DataFrame:
    """(query_id, id, score): the best ``k`` of each query in each tile of the cells that it reads.

    A cell's vectors and its queries are cut into slices; each two of them are one product.
    """
    spark = rows.sparkSession
    slices = spark.createDataFrame([(c, max(1, -(-n // tile))) for c, n in counts.items()], "cell int, vi int")  # a row per cell
    asked = routed.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("qi")).join(F.broadcast(slices), "cell")
    asked = materialise(asked, "asked")  # as many rows as cells
    far = 1 << 20
    q = routed.join(F.broadcast(asked), "cell").withColumn("_i", F.pmod(F.xxhash64("query_id"), F.col("qi")).cast("int"))
    q = q.select("cell", F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "query_id", "embedding", F.col("_i").alias("_slice"), "_i", F.explode(F.sequence(F.lit(far), F.col("vi") + (far - 1))).alias("_j"))
    v = rows.where("angle is not null").join(F.broadcast(asked), "cell").withColumn("_j", (F.pmod(F.xxhash64("id"), F.col("vi")) + far).cast("int"))
    v = v.select("cell", "id", F.lit(None).cast(routed.schema["query_id"].dataType).alias("query_id"), "embedding", F.col("_j").alias("_slice"), F.explode(F.sequence(F.lit(0), F.col("qi") - 1)).alias("_i"), "_j")
    kinds = [routed.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()]

    def compare(a: pa.Table, b: pa.Table) -> pa.RecordBatch:
        if not (a.num_rows and b.num_rows):
            return pa.RecordBatch.from_arrays([a.column("query_id").slice(0, 0).combine_chunks(), b.column("id").slice(0, 0).combine_chunks(), pa.array([], pa.float64())], ["query_id", "id", "score"])
        score = np.clip(unit_rows(a.column("embedding")) @ unit_rows(b.column("embedding")).T, 0.0, 1.0)
        bar = np.partition(score, max(0, score.shape[1] - k), axis=1)[:, max(0, score.shape[1] - k)]
        i, j = np.nonzero(score >= bar[:, None])  # ties at the bar stay: ids decide later
        return pa.RecordBatch.from_arrays([a.column("query_id").take(pa.array(i)).combine_chunks(), b.column("id").take(pa.array(j)).combine_chunks(), pa.array(score[i, j])], ["query_id", "id", "score"])

    return per_tile(q.unionByName(v), ["cell"], compare, f"query_id {kinds[0]}, id {kinds[1]}, score double")


def _best(hits: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))  # k rows and ties per tile read
    return hits.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def search_many(queries: DataFrame, path: str, k: int, probes: int | None = None, exact: bool = False, tile: int = TILE) -> DataFrame:
    """(query_id, id, score): the nearest ``k`` of each of ``queries`` (query_id, embedding), as :func:`search_vectors` gives them.

    Queries are sent to the cells that they read, cells without queries aren't read. Queries without direction or of another size find nothing.
    """
    spark = queries.sparkSession
    every = _cells(spark, path)
    cells = [c for c in every if c.rows]
    rows = _rows(spark, path)
    kinds = [queries.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()]
    if not cells:
        return spark.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}, score double")
    probes = _probes(spark, path, probes)
    asked = materialise(queries.where(_sound(len(cells[0].centre))).select("query_id", F.col("embedding").cast("array<double>").alias("embedding")), "queries")
    counts = {c.cell: c.rows for c in cells}

    def read(routed: DataFrame) -> DataFrame:
        routed = materialise(routed, "routed")
        wanted = [r.cell for r in routed.select("cell").distinct().collect()]  # cells, not rows
        return _scored(routed, rows.where(F.col("cell").isin(*wanted)), {c: counts[c] for c in wanted}, k, tile) if wanted else None

    found = read(_routed(asked, cells, probes, False))
    if found is None:
        return spark.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}, score double")
    odd = rows.where((F.col("cell") == ODD) & (F.size("embedding") == len(cells[0].centre)) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    none = [r.id for r in odd.orderBy("id").limit(k).select("id").collect()]  # zero vectors score 0 with every query: the first k by id count
    if none:
        found = found.unionByName(asked.select("query_id", F.explode(F.array(*[F.lit(x) for x in none])).alias("id"), F.lit(0.0).alias("score")))
    best = materialise(_best(found, k), "best")
    if not exact:
        return best
    reached = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    bar = F.when((F.col("n") >= k) & (F.col("least") > 0), F.col("least")).otherwise(-1.0)
    more = read(_routed(asked.join(reached, "query_id", "left").select("query_id", "embedding", bar.alias("bar")), cells, probes, True))
    return best if more is None else _best(best.unionByName(more), k)


_COS = "greatest(0.0, least(1.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"


def _index(spark, d) -> str:
    path = scratch_path(spark, "vectors")
    build_vector_index(m.table(spark, d, "embeddings"), path)
    return path


@query("search_vector_index", f"SELECT a.vec_id AS id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 3 ORDER BY {_COS} DESC, id LIMIT 25")
def search_vector_index(spark, d):
    """One query by a stored index, exact."""
    seed = m.table(spark, d, "embeddings").where("vec_id = 3").first()
    return search_vectors(spark, _index(spark, d), list(seed.embedding) if seed else [], 25, exact=True).select("id", F.round("score", 6).alias("score"))


@query("search_vector_batch", f"SELECT query_id, id, round(score, 6) AS score FROM (SELECT b.vec_id AS query_id, a.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_COS} DESC, a.vec_id) AS place FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0) WHERE place <= 10")
def search_vector_batch(spark, d):
    """The nearest ten of every twentieth vector, exact."""
    queries = m.table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search_many(queries, _index(spark, d), 10, exact=True).select("query_id", "id", F.round("score", 6).alias("score"))
