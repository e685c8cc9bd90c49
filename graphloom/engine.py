"""One object over a graph's tables: load, clean, chunk, embed, extract, search, analyse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import chunking
from graphloom.functions import pages as pages_of
from graphloom.functions import text as t
from graphloom.operators import graph, ranking, relational, resolution, retrieval, stats, vector_index
from graphloom.registry import clean
from graphloom.sources import exchange, loaders


class Engine:
    """``embed`` turns a text column into vectors; the default hashes words and needs no model.

    Tables: nodes (id, label, template_id, source_id), edges (src, dst, template_id), chunks (chunk_id, doc_id, content),
    sources (source_id, enabled, ...), citations (entity_uri, chunk_id, ...); those not needed may be missing.
    """

    def __init__(self, spark: SparkSession, embed: Callable[[Column], Column] = retrieval.hashed_embedding, **tables: DataFrame):
        self.spark, self.embed, self.tables, self.index = spark, embed, tables, None

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(f"no table {name}") from None

    # ---- ingest ----------------------------------------------------------------------------

    def load(self, path: str) -> DataFrame:
        """(doc_id, path, content) of files, the id from path and part."""
        return loaders.load(self.spark, path).select(F.xxhash64("path", "part").alias("doc_id"), "path", "content")

    def clean(self, docs: DataFrame) -> DataFrame:
        return clean(docs, "content", "content")

    def chunk(self, docs: DataFrame, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> DataFrame:
        parts = chunking.split_documents(docs.select("doc_id", F.col("content").alias("text")), "text", size, overlap)
        return parts.withColumn("chunk_id", F.xxhash64("doc_id", "chunk_index"))

    def embed_chunks(self, chunks: DataFrame) -> DataFrame:
        return chunks.withColumn("embedding", self.embed(F.col("content")))

    def extract(self, answers: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
        """(entities, relationships) of a model's answers in record lines; what doesn't parse is left out."""
        lines = t.parse_lines(answers, text).where("valid")
        f = lambda k: t.unescape_field(F.col("fields")[k])
        entities = lines.where("kind = 'E'").select(*answers.columns, "line_no", f(1).alias("name"), f(2).alias("type"), t.aliases_of(f(3)).alias("aliases"), t.safe_float(f(4)).alias("confidence"), f(5).alias("sent_ref"), f(6).alias("description"))
        relations = lines.where("kind = 'R'").select(*answers.columns, "line_no", f(1).alias("source"), f(2).alias("target"), t.edge_label(f(3)).alias("type"), t.safe_float(f(4)).alias("confidence"), f(5).alias("sent_ref"), f(6).alias("justification"))
        return entities, relations

    def commit(self, nodes: DataFrame, edges: DataFrame) -> Engine:
        """An engine whose graph also has the new nodes and edges; ids that are there stay as they are."""
        merged = relational.upsert(self.nodes, nodes, "id", "label").drop("inserted")
        return Engine(self.spark, self.embed, **{**self.tables, "nodes": merged, "edges": self.edges.unionByName(edges).distinct()})

    def delete(self, ids: list[str]) -> Engine:
        gone = self.spark.createDataFrame([(i,) for i in ids], "id string")
        nodes, edges = relational.delete_cascade(self.nodes, self.edges, gone)
        return Engine(self.spark, self.embed, **{**self.tables, "nodes": nodes, "edges": edges})

    def export(self, scope: list[int] | None = None) -> DataFrame:
        nodes, edges = (self.nodes, self.edges) if scope is None else exchange.export_graph(self.nodes, self.edges, scope)
        return exchange.to_linked(nodes, edges)

    # ---- search ----------------------------------------------------------------------------

    def build_index(self, path: str) -> None:
        """Write the keyword and the vector index of the chunks; searches read them from then on."""
        retrieval.build_index(self.chunks, {"content": 1.0}, path, "chunk_id")
        vector_index.build_vector_index(self._vectors(), f"{path}/near", "chunk_id")
        self.index = path

    def search(self, query: str, mode: str = "hybrid", k: int = 10, least: float = 0.55) -> DataFrame:
        """(id, score) of chunks; mode is keyword, semantic or hybrid. An empty query finds nothing.

        Without :meth:`build_index` the chunks' texts are read; without a vector column they are embedded.
        """
        terms = query.lower().split()
        found = retrieval.search_index(self.spark, self.index, terms) if self.index else retrieval.keyword(self.chunks, terms, {"content": 1.0}, "chunk_id", stemmed=True)
        found = found.select("id", (F.col("score") / (1 + F.col("score"))).alias("score"))
        if mode == "keyword" or not terms:
            return found.orderBy(F.desc("score"), "id").limit(k)
        vector = self._vector(query)
        semantic = vector_index.search_vectors(self.spark, f"{self.index}/near", vector, 3 * k) if self.index else retrieval.knn(self._vectors(), vector, 3 * k, key="chunk_id")
        return semantic.limit(k) if mode == "semantic" else retrieval.hybrid(found, semantic, query, k, least)

    def _vectors(self) -> DataFrame:
        return self.chunks if "embedding" in self.chunks.columns else self.embed_chunks(self.chunks)

    def _vector(self, text: str) -> list[float]:
        return list(self.spark.range(1).select(self.embed(F.lit(text)).alias("v")).first().v)

    def resolve(self, name: str, limit: int = 5) -> DataFrame:
        return retrieval.resolve(self.nodes, name, limit)

    def resolve_node(self, text: str, alternatives: int = 3, scope: list | None = None) -> DataFrame:
        """The node that a name, nickname or description means, and others; see :func:`retrieval.resolved`."""
        vectors = self.nodes.select("id", "embedding") if "embedding" in self.nodes.columns else self.nodes.select("id", self.embed(F.col("label")).alias("embedding"))
        return retrieval.resolved(self.nodes, text, vectors, self._vector(text), alternatives, scope)

    def bridges(self) -> DataFrame:
        return graph.bridges(self.nodes, self.edges)

    def betweenness(self, sources: DataFrame | None = None) -> DataFrame:
        return graph.betweenness(self.nodes, self.edges, sources)

    def fetch(self, pages: DataFrame, **how) -> DataFrame:
        """Main text, title and errors of fetched pages (url, html); see :func:`pages.fetched`."""
        return pages_of.fetched(pages, **how)

    def graph_search(self, query: str, limit: int = 10, **how) -> graph.GraphAnswer:
        """Chunks, triples and statistics for a question; see :func:`graph.graph_search`."""
        vectors = self.nodes.select("id", self.embed(F.col("label")).alias("embedding")) if "embedding" not in self.nodes.columns else self.nodes.select("id", "embedding")
        chunks = self.chunks if "source_id" in self.chunks.columns else self.chunks.withColumn("source_id", F.lit(None).cast("int"))
        found = self._vectors().select(F.col("chunk_id").alias("id"), "embedding")
        return graph.graph_search(self.nodes, self.edges, self.citations, chunks, vectors, found, query, self._vector(query) if query.strip() else [], limit, **how)

    def fuse(self, *hits: DataFrame) -> DataFrame:
        lists = [ranking.ranks(h.select(F.lit(i).alias("list"), "id", "score")) for i, h in enumerate(hits)]
        out = lists[0]
        for h in lists[1:]:
            out = out.unionByName(h)
        return ranking.rrf(out)

    # ---- analysis --------------------------------------------------------------------------

    def components(self) -> DataFrame:
        return graph.components(self.nodes, self.edges)

    def pagerank(self, seeds: dict[str, float] | None = None, **how) -> DataFrame:
        return graph.pagerank(self.nodes, self.edges, seeds=seeds, **how)

    def path(self, start: str, goal: str) -> DataFrame:
        return graph.shortest_path(self.nodes, self.edges, start, goal)

    def node_stats(self) -> DataFrame:
        return stats.node_stats(self.nodes, self.edges, self.citations)

    def breakdown(self) -> DataFrame:
        return stats.graph_breakdown(self.nodes, self.edges, self.sources)

    def quality(self, entities: DataFrame, relationships: DataFrame) -> DataFrame:
        return stats.source_quality(entities, relationships)

    def resolve_entities(self, entities: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Entities with their canonical one by exact name, relationships between canonical entities."""
        found = resolution.exact_names(entities, [])
        return found, resolution.remapped(relationships, found.select("ordinal", "canonical"))
