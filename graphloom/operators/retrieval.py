"""Keyword, vector, hybrid and graph-augmented search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom import model as m
from graphloom.catalog import query
from graphloom.functions.stem import stem, stems
from graphloom.operators.ranking import ranks, rrf, union_max
from graphloom.operators.relational import endpoints, in_enabled_sources, sql
from graphloom.plans.scratch import materialise, scratch_path

K1, B = 1.2, 0.75
#: Texts whose words are counted at a time.
_COUNTED = 256


def dot(a: Column, b: Column) -> Column:
    """In double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either is all zeros; null if sizes differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm))


def words(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def fields_of(docs: DataFrame, fields: dict[str, float], key: str, stemmed: bool) -> DataFrame:
    """(id, _words_0, _words_1, ..., length): the words of each field, stemmed or not, and how many they are in all; fields that ``docs`` lacks are empty."""
    none = F.array().cast("array<string>")
    each = {f"_words_{k}": F.coalesce(words(f), none) if f in docs.columns else none for k, f in enumerate(fields)}
    out = docs.select(F.col(key).alias("id"), *[(stems(c) if stemmed else c).alias(n) for n, c in each.items()])
    total = F.size("_words_0")
    for n in list(each)[1:]:
        total = total + F.size(n)
    return out.withColumn("length", total)


def idf(n: Column, df: Column) -> Column:
    """Of a term in df of n texts; a term in over half of them counts next to nothing."""
    value = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(value > 0, value).otherwise(1e-6)


def keyword(docs: DataFrame, terms: list[str], fields: dict[str, float], key: str = "doc_id", stemmed: bool = False) -> DataFrame:
    """(id, score): BM25 of texts for some terms, occurrences weighted by field; no term, no hit.

    Only counts of these terms are taken from a text, so nothing is shuffled: one pass sums up how many texts have each term and how long they are,
    one scores.
    """
    wanted = sorted({stem(x) if stemmed else x for x in (t.lower() for t in terms) if x})
    split = fields_of(docs, fields, key, stemmed)
    times = lambda n, x: F.size(F.filter(n, lambda w: w == x))
    tf = []
    for x in wanted:
        parts = [times(f"_words_{k}", x) * weight for k, weight in enumerate(fields.values())]
        tf.append(sum(parts[1:], parts[0]).cast("double"))
    counted = split.select("id", "length", *[c.alias(f"_tf_{k}") for k, c in enumerate(tf)])
    if not wanted:
        return counted.limit(0).select("id", F.lit(0.0).alias("score"))
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"_tf_{k}") > 0).alias(f"_df_{k}") for k in range(len(wanted))]).first()
    score = F.lit(0.0)
    for k in range(len(wanted)):
        f = F.col(f"_tf_{k}")
        norm = f + K1 * (1 - B + B * F.col("length") / (stats.mean or 1.0))
        score = score + idf(F.lit(stats.n), F.lit(stats[f"_df_{k}"])) * f * (K1 + 1) / norm
    hit = F.lit(False)
    for k in range(len(wanted)):
        hit = hit | (F.col(f"_tf_{k}") > 0)
    return counted.where(hit).select("id", score.alias("score"))


def build_index(docs: DataFrame, fields: dict[str, float], path: str, key: str = "doc_id", stemmed: bool = True, buckets: int = 256) -> None:
    """Write an inverted index: postings (bucket, term, id, tf, length), a folder per bucket of terms, and statistics of one row.

    A later search reads the folders of its terms. An index that is there is replaced.
    """
    split = fields_of(docs, fields, key, stemmed)

    weights = [float(x) for x in fields.values()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _COUNTED):
                part = batch.slice(start, _COUNTED)
                row, term, w = [], [], []
                for k, weight in enumerate(weights):
                    row.append(pc.list_parent_indices(part.column(f"_words_{k}")))
                    term.append(pc.list_flatten(part.column(f"_words_{k}")))
                    w.append(pa.array(np.full(len(row[-1]), weight)))
                every = pa.table([pa.chunked_array(x) for x in (row, term, w)], ["row", "term", "w"])
                got = every.group_by(["row", "term"], use_threads=False).aggregate([("w", "sum")]).combine_chunks()
                for piece in got.to_batches():
                    at = piece.column("row")
                    yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("length").take(at), piece.column("term"), piece.column("w_sum")], ["id", "length", "term", "tf"])

    kinds = dict(split.dtypes)
    # a row's words are counted where the row is: only postings are shuffled, once, to their buckets
    terms = split.select("id", "length", *[f"_words_{k}" for k in range(len(weights))]).mapInArrow(count, f"id {kinds['id']}, length {kinds['length']}, term string, tf double")
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    terms.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    split.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(1.0)).alias("mean"), F.lit(stemmed).alias("stemmed"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/stats")


def search_index(spark, path: str, terms: list[str]) -> DataFrame:
    """(id, score) by a written index, as :func:`keyword` gives them."""
    stats = spark.read.parquet(f"{path}/stats").first()
    wanted = sorted({stem(x) if stats.stemmed else x for x in (t.lower() for t in terms) if x})
    rows = spark.read.parquet(f"{path}/postings")
    if not wanted:
        return rows.limit(0).select("id", F.lit(0.0).alias("score"))
    at = {r.b for r in spark.createDataFrame([(w,) for w in wanted], "term string").select(F.pmod(F.xxhash64("term"), F.lit(stats.buckets)).cast("int").alias("b")).collect()}
    hits = rows.where(F.col("bucket").isin(*at) & F.col("term").isin(*wanted))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / stats.mean)
    scored = hits.join(F.broadcast(df), "term")  # a row per term of the query
    return scored.groupBy("id").agg(F.sum(idf(F.lit(stats.n), F.col("df")) * F.col("tf") * (K1 + 1) / norm).alias("score"))


def knn(vectors: DataFrame, query_vector: list[float], k: int, least: float | None = None, key: str = "vec_id") -> DataFrame:
    """(id, score): the nearest by cosine, scores held to 0..1; vectors of another size never match."""
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("embedding"), q)))
    hits = vectors.where(F.size("embedding") == len(query_vector)).select(F.col(key).alias("id"), score.alias("score"))
    if least is not None:
        hits = hits.where(F.col("score") >= least)
    return hits.orderBy(F.desc("score"), "id").limit(k)


def hybrid(keyword: DataFrame, semantic: DataFrame, query_text: str, k: int, least: float = 0.55) -> DataFrame:
    """(id, score): the higher of keyword and semantic score; below three characters keywords alone."""
    hits = keyword if len(query_text) < 3 else union_max(keyword, semantic.where(F.col("score") >= least))
    return hits.orderBy(F.desc("score"), "id").limit(k)


TERMS = ["onreen", "thing", "ndble", "hahaha", "de"]


def bm25_sql(rows: str, terms: list[str], name: str = "bm", properties: bool = False) -> str:
    """CTEs that end in ``name`` (id, score): BM25 over ``rows``, a query of (id, label, text) with weights 3 and 0.5, and where it has ``properties`` 1 for these."""
    listed = ", ".join(f"'{t}'" for t in terms)
    cut = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')"
    return f"""{name}_t AS MATERIALIZED (SELECT id, {cut('label')} AS a, {cut('text')} AS b, {cut('properties' if properties else "''")} AS c FROM ({rows})), {name}_l AS (SELECT id, len(a) + len(b) + len(c) AS l FROM {name}_t), {name}_c AS (SELECT count(*) AS n, avg(l) AS mean FROM {name}_l),
  {name}_f AS (SELECT id, term, sum(w) AS tf FROM (SELECT id, unnest(a) AS term, 3.0::DOUBLE AS w FROM {name}_t UNION ALL SELECT id, unnest(b), 0.5 FROM {name}_t UNION ALL SELECT id, unnest(c), 1.0 FROM {name}_t) WHERE term IN ({listed}) GROUP BY 1, 2), {name}_d AS (SELECT term, count(*) AS df FROM {name}_f GROUP BY 1),
  {name} AS (SELECT id, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS score FROM {name}_f JOIN {name}_d USING (term) JOIN {name}_l USING (id), {name}_c GROUP BY 1)"""


FIELDS = {"label": 3.0, "properties": 1.0, "text": 0.5}
_DOC_ROWS = "SELECT doc_id AS id, string_split(text, chr(10))[1] AS label, text, coalesce(source, '') || ' ' || coalesce(lang, '') AS properties FROM documents"
_BM25 = f"WITH {bm25_sql(_DOC_ROWS, TERMS, properties=True)}"


def _titled(spark, d) -> DataFrame:
    """Documents with their first line as label, their source and language as properties."""
    return m.table(spark, d, "documents").select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("label"), "text", F.concat(F.coalesce("source", F.lit("")), F.lit(" "), F.coalesce("lang", F.lit(""))).alias("properties"))


def _keyword(spark, d) -> DataFrame:
    return keyword(_titled(spark, d), TERMS, FIELDS)


@query("search_keyword", f"{_BM25} SELECT id, round(score, 5) AS score FROM bm")
def search_keyword(spark, d):
    return _keyword(spark, d).select("id", F.round("score", 5).alias("score"))


@query("search_keyword_index", f"{_BM25} SELECT id, round(score, 5) AS score FROM bm")
def search_keyword_index(spark, d):
    """The same by a written index."""
    path = scratch_path(spark, "index")
    build_index(_titled(spark, d), FIELDS, path, stemmed=False)
    return search_index(spark, path, TERMS).select("id", F.round("score", 5).alias("score"))


@query("search_keyword_stemmed")
def search_keyword_stemmed(spark, d):
    """Stems of words and of the query's terms; tested against plain Python."""
    return keyword(_titled(spark, d), ["things", "hahahaing", "relating"], FIELDS, stemmed=True).select("id", F.round("score", 5).alias("score"))


def _vector(spark, d, k: int, least: float | None = None) -> DataFrame:
    e = m.table(spark, d, "embeddings")
    seed = e.where("vec_id = 3").select("embedding").first()  # the query
    return knn(e, list(seed.embedding) if seed else [], k, least)


_COS = "greatest(0.0, least(1.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"
_SEMANTIC = f"(SELECT a.vec_id AS id, {_COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id = 3 ORDER BY score DESC, id LIMIT 25)"


@query("search_vector", f"SELECT id, round(score, 6) AS score FROM {_SEMANTIC}")
def search_vector(spark, d):
    return _vector(spark, d, 25).select("id", F.round("score", 6).alias("score"))


def hashed_embedding(text: Column | str, size: int = 64) -> Column:
    """A deterministic stand-in for a model: counts of words by hash, signed."""
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(hashes, lambda h: F.pmod(h, F.lit(size)) == i), F.lit(0.0), lambda s, h: s + F.when(h > 0, 1.0).otherwise(-1.0)))


@query("search_semantic")
def search_semantic(spark, d):
    """Benchmark items nearest to a query text, embedded by the stand-in model."""
    docs = m.table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id"), hashed_embedding("text").alias("embedding"))
    vector = spark.range(1).select(hashed_embedding(F.lit("the thing of and that")).alias("v")).first().v
    return knn(docs, vector, 10).select("id", F.round("score", 6).alias("score"))


@query("search_hybrid", f"{_BM25}, k AS (SELECT id, score / (1 + score) AS score FROM bm), s AS (SELECT * FROM {_SEMANTIC} WHERE score >= 0.2) SELECT id, round(max(score), 5) AS score FROM (SELECT * FROM k UNION ALL SELECT * FROM s) GROUP BY id ORDER BY max(score) DESC, id LIMIT 40")
def search_hybrid(spark, d):
    k = _keyword(spark, d).select("id", (F.col("score") / (1 + F.col("score"))).alias("score"))
    return hybrid(k, _vector(spark, d, 25), "the of", 40, 0.2).select("id", F.round("score", 5).alias("score"))


def _templates(spark, d) -> DataFrame:
    """(name, kind, description, uses, embedding): templates of nodes and edges; the k-th by name has the k-th vector."""
    counted = m.nodes(spark, d).groupBy(F.col("template_id").alias("name")).agg(F.count("*").alias("uses")).withColumn("kind", F.lit("node"))
    counted = counted.unionByName(m.edges(spark, d).groupBy(F.col("template_id").alias("name")).agg(F.count("*").alias("uses")).withColumn("kind", F.lit("edge")))
    placed = counted.withColumn("vec_id", F.row_number().over(Window.orderBy("name")).cast("bigint"))  # as many rows as there are templates
    described = placed.withColumn("description", F.concat(F.lit("A kind of "), F.when(F.col("kind") == "node", "thing").otherwise("relation"), F.when(F.col("name").contains("_"), F.lit(" between things")).otherwise("")))
    return described.join(m.table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "left").drop("vec_id")


_TEMPLATES = """counted AS (SELECT template_id AS name, count(*) AS uses, 'node' AS kind FROM nodes GROUP BY 1 UNION ALL SELECT template_id, count(*), 'edge' FROM edges GROUP BY 1), placed AS (SELECT *, row_number() OVER (ORDER BY name) AS vec_id FROM counted),
  templates AS (SELECT name, kind, uses, 'A kind of ' || CASE WHEN kind = 'node' THEN 'thing' ELSE 'relation' END || CASE WHEN contains(name, '_') THEN ' between things' ELSE '' END AS description, embedding FROM placed LEFT JOIN embeddings USING (vec_id))"""
#: Words that stand for others in a search for templates.
SYNONYMS = {"company": ("supplier", "customer"), "location": ("nation", "region", "located"), "thing": ("part",)}


def template_keyword(templates: DataFrame, text: str, synonyms: dict[str, tuple[str, ...]] = SYNONYMS) -> DataFrame:
    """(name, score): 1 if the name holds the query, 0.85 a synonym of one of its words, 0.7 and 0.6 for the description; the best counts."""
    low = text.strip().lower()
    others = sorted({s for w in low.split() for s in synonyms.get(w, ())})
    name, about = F.lower("name"), F.lower(F.coalesce("description", F.lit("")))
    any_of = lambda c: F.exists(F.array(*[F.lit(s) for s in others]), lambda s: F.contains(c, s)) if others else F.lit(False)
    score = F.when(F.contains(name, F.lit(low)), 1.0).when(any_of(name), 0.85).when(F.contains(about, F.lit(low)), 0.7).when(any_of(about), 0.6)
    return templates.where(F.lit(low) != "").select("name", score.alias("score")).where("score is not null").groupBy("name").agg(F.max("score").alias("score"))


_TEMPLATE_HITS = "hits AS (SELECT name, max(CASE WHEN contains(name, 'thing') THEN 1.0::DOUBLE WHEN contains(name, 'part') THEN 0.85 WHEN contains(lower(description), 'thing') THEN 0.7 WHEN contains(lower(description), 'part') THEN 0.6 END) AS score FROM templates GROUP BY 1)"


@query("search_template_keyword", sql(f"WITH {_TEMPLATES}, {_TEMPLATE_HITS} SELECT * FROM hits WHERE score IS NOT NULL"))
def search_template_keyword(spark, d):
    return template_keyword(_templates(spark, d), "thing")


def search_templates(templates: DataFrame, text: str, query_vector: list[float], limit: int = 10, least: float = 0.4, kind: str | None = None) -> DataFrame:
    """(name, uses, score): the nearest templates of 3 * ``limit`` at ``least`` or more, then by name those not among them; most used first."""
    wanted = templates if kind is None else templates.where(F.col("kind") == kind)
    near = knn(wanted.where("embedding is not null"), query_vector, 3 * limit, least, "name")
    more = template_keyword(wanted, text).select(F.col("name").alias("id"), "score").join(near.select("id"), "id", "left_anti")
    both = near.unionByName(more).join(wanted.select(F.col("name").alias("id"), "uses"), "id")
    return both.orderBy(F.desc("uses"), F.desc("score"), "id").limit(limit).select(F.col("id").alias("name"), "uses", "score")


@query("search_template", sql(f"""WITH {_TEMPLATES}, {_TEMPLATE_HITS}, near AS (SELECT a.name, {_COS} AS score FROM templates a, embeddings b WHERE b.vec_id = 3 AND a.kind = 'node' AND a.embedding IS NOT NULL), close AS (SELECT * FROM near WHERE score >= 0.05 ORDER BY score DESC, name LIMIT 12),
  every AS (SELECT * FROM close UNION ALL SELECT h.name, h.score FROM hits h JOIN templates t ON t.name = h.name AND t.kind = 'node' WHERE h.score IS NOT NULL AND h.name NOT IN (SELECT name FROM close)) SELECT e.name, uses, round(e.score, 6) AS score FROM every e JOIN templates t ON t.name = e.name AND t.kind = 'node' ORDER BY uses DESC, e.score DESC, e.name LIMIT 4"""))
def search_template(spark, d):
    seed = m.table(spark, d, "embeddings").where("vec_id = 3").first()
    return search_templates(_templates(spark, d), "thing", list(seed.embedding) if seed else [], 4, 0.05, "node").withColumn("score", F.round("score", 6))


def resolve(nodes: DataFrame, name: str, limit: int = 5) -> DataFrame:
    """Candidates of a name: equal 1.0, starting with it 0.8, holding it 0.6, best first."""
    n, low = F.lower("label"), name.lower()
    score = F.when(n == low, 1.0).when(n.startswith(low), 0.8).when(n.contains(low), 0.6)
    return nodes.select("id", "label", score.alias("score")).where("score is not null").orderBy(F.desc("score"), "id").limit(limit)


@query("search_hydrate", sql(f"SELECT h.id, n.label, n.template_id, round(h.score, 6) AS score FROM (SELECT 'c:' || id AS id, score FROM {_SEMANTIC}) h JOIN nodes n ON n.id = h.id LEFT JOIN sources s ON n.source_id = s.source_id WHERE n.source_id IS NULL OR s.enabled"))
def search_hydrate(spark, d):
    hits = _vector(spark, d, 25).select(F.concat(F.lit("c:"), "id").alias("id"), F.round("score", 6).alias("score"))
    return in_enabled_sources(m.nodes(spark, d).join(F.broadcast(hits), "id"), m.sources(spark, d)).select("id", "label", "template_id", "score")


_NODE_ROWS = "SELECT id, label, '' AS text FROM nodes"
_NODE_NEAR = f"SELECT 'c:' || a.vec_id AS id, {_COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id = 3"
_CHUNK_NEAR = f"SELECT a.vec_id * 16777216 AS id, {_COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id = 3"


def _query_vector(spark, d) -> list[float]:
    seed = m.table(spark, d, "embeddings").where("vec_id = 3").first()
    return list(seed.embedding) if seed else []


def _node_vectors(spark, d) -> DataFrame:
    """Customers have the vectors of their number."""
    return m.table(spark, d, "embeddings").select(F.concat(F.lit("c:"), "vec_id").alias("id"), "embedding")


def _chunk_vectors(spark, d) -> DataFrame:
    """The first chunk of a document has the vector of its number."""
    return m.table(spark, d, "embeddings").select((F.col("vec_id") * 16777216).alias("id"), "embedding")


def hybrid_hits(docs: DataFrame, vectors: DataFrame, text: str, query_vector: list[float], least: float = 0.55, fields: dict[str, float] | None = None) -> DataFrame:
    """(id, score): keyword hits and vectors (id, embedding) at ``least`` or nearer, the higher score of each; keywords alone below three characters
    or without a query vector. Not cut off, so that filters come before the best are taken."""
    found = keyword(docs, text.split(), fields or FIELDS, "id").select("id", (F.col("score") / (1 + F.col("score"))).alias("score"))
    if len(text) < 3 or not query_vector:
        return found
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("embedding"), q)))
    near = vectors.where(F.size("embedding") == len(query_vector)).select("id", score.alias("score")).where(F.col("score") >= least)
    return union_max(found, near)


# Properties that hold other names of a node.
ALIAS_KEYS = ("aliases", "nicknames", "also_known_as", "titles")


def alias_list(properties: Column) -> Column:
    """The other names among a node's properties (a map of texts), a list written as JSON or one name each, in the order of ``ALIAS_KEYS``."""
    none = F.array().cast("array<string>")
    value = lambda k: F.element_at(properties, F.lit(k))
    names = lambda k: F.when(F.coalesce(value(k), F.lit("")) == "", none).when(value(k).startswith("["), F.coalesce(F.from_json(value(k), "array<string>"), none)).otherwise(F.array(value(k)))
    return F.flatten(F.array(*[names(k) for k in ALIAS_KEYS]))


def resolved(nodes: DataFrame, text: str, vectors: DataFrame, query_vector: list[float], alternatives: int = 3, scope: list | None = None, least: float = 0.55) -> DataFrame:
    """(place, id, label, template_id, confidence, method, aliases): the node that a name, nickname or description means, at place 0, and up to ``alternatives`` others.

    Keywords in labels and properties come first. Without a hit, or with a best one below 1, the higher of keyword and vector score counts instead if its best is better.
    Nodes of other sources than those in ``scope`` are left out afterwards, those without a source stay.
    """
    many = alternatives + 2
    has = "properties" in nodes.columns
    props = F.col("properties") if has else F.create_map().cast("map<string,string>")
    docs = nodes.select("id", "label", F.array_join(F.map_values(F.coalesce(props, F.create_map().cast("map<string,string>"))), " ").alias("properties"))
    found = materialise(keyword(docs, text.split(), FIELDS, "id").orderBy(F.desc("score"), "id").limit(many), "hits")
    best = found.agg(F.max("score").alias("best")).first().best
    method = "keyword"
    if best is None or best < 1.0:
        near = knn(vectors.join(nodes.select("id"), "id", "left_semi"), query_vector, many, key="id") if query_vector else found.limit(0)
        both = materialise(hybrid(found, near, text, many, least), "hits")
        top = both.agg(F.max("score").alias("best")).first().best
        if top is not None and (best is None or top > best):
            found, method = both, "hybrid"
    hits = nodes.join(F.broadcast(found), "id")  # as many rows as asked for
    if scope:
        hits = hits.where(F.col("source_id").isNull() | F.col("source_id").isin(*scope))
    ranked = hits.select(F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("n"), "id", "label", "template_id", F.col("score").alias("confidence"), alias_list(props).alias("aliases"))
    return ranked.where(F.col("n") <= alternatives + 1).select((F.col("n") - 1).alias("place"), "id", "label", "template_id", "confidence", F.lit(method).alias("method"), "aliases")


def _described(spark, d) -> DataFrame:
    """Nodes with properties: a title of some, nicknames as a list and a note of others."""
    k = F.right(F.col("id"), F.lit(1)).cast("int") % 4
    name = F.concat(F.lit("nick"), k, F.lit(" "), F.col("template_id"))
    props = F.when(k == 0, F.create_map(F.lit("titles"), name)).when(k == 1, F.create_map(F.lit("nicknames"), F.concat(F.lit('["'), name, F.lit('","'), F.lower("label"), F.lit('"]')), F.lit("note"), F.lit("ring")))
    return m.nodes(spark, d).withColumn("properties", props)


def _resolved(spark, d, text: str, scope: list | None = None) -> DataFrame:
    found = resolved(_described(spark, d), text, _node_vectors(spark, d), _query_vector(spark, d), scope=scope, least=0.2)
    return found.select("place", "id", "label", "template_id", F.round("confidence", 5).alias("confidence"), "method", F.array_join("aliases", "|").alias("aliases"))


def _resolved_sql(text: str, scope: str = "true") -> str:
    rows = "SELECT id, label, '' AS text, coalesce(properties, '') AS properties FROM named"
    return sql(f"""WITH named AS MATERIALIZED (SELECT *, CASE k WHEN 0 THEN 'nick0 ' || template_id WHEN 1 THEN '["nick1 ' || template_id || '","' || lower(label) || '"] ring' END AS properties FROM (SELECT *, CAST(right(id, 1) AS INTEGER) % 4 AS k FROM nodes)),
  {bm25_sql(rows, text.lower().split(), properties=True)}, kw AS (SELECT * FROM bm ORDER BY score DESC, id LIMIT 5), near AS (SELECT * FROM ({_NODE_NEAR}) WHERE id IN (SELECT id FROM nodes) ORDER BY score DESC, id LIMIT 5),
  hy AS (SELECT id, max(score) AS score FROM (SELECT * FROM kw UNION ALL SELECT * FROM near WHERE score >= 0.2) GROUP BY id ORDER BY max(score) DESC, id LIMIT 5), u AS (SELECT coalesce((SELECT max(score) FROM kw), 0) < 1 AND (SELECT max(score) FROM hy) > coalesce((SELECT max(score) FROM kw), -1) AS u),
  f AS (SELECT *, 'hybrid' AS method FROM hy WHERE (SELECT u FROM u) UNION ALL SELECT *, 'keyword' FROM kw WHERE NOT coalesce((SELECT u FROM u), false)), r AS (SELECT named.*, score, method, row_number() OVER (ORDER BY score DESC, named.id) - 1 AS place FROM f JOIN named ON named.id = f.id WHERE {scope})
  SELECT CAST(place AS INTEGER) AS place, id, label, template_id, round(score, 5) AS confidence, method, CASE k WHEN 0 THEN properties WHEN 1 THEN 'nick1 ' || template_id || '|' || lower(label) ELSE '' END AS aliases FROM r WHERE place <= 3""")


@query("resolve_node_alias", _resolved_sql("Nick1 Region", "source_id IS NULL OR source_id IN (1, 2, 3)"))
def resolve_node_alias(spark, d):
    """A nickname, within some sources."""
    return _resolved(spark, d, "Nick1 Region", [1, 2, 3])


@query("resolve_node_hybrid", _resolved_sql("somebody nobody knows"))
def resolve_node_hybrid(spark, d):
    """A description that no word of a node's matches: by vector."""
    return _resolved(spark, d, "somebody nobody knows")


@query("resolve_node", sql("SELECT id, label, CAST(CASE WHEN lower(label) = 'nation_1' THEN 1.0 WHEN starts_with(lower(label), 'nation_1') THEN 0.8 WHEN contains(lower(label), 'nation_1') THEN 0.6 END AS DOUBLE) AS score FROM nodes WHERE contains(lower(label), 'nation_1') ORDER BY score DESC, id LIMIT 5"))
def resolve_node(spark, d):
    """By the label alone."""
    return resolve(m.nodes(spark, d), "Nation_1")


def search_nodes_by(nodes: DataFrame, sources: DataFrame, vectors: DataFrame, text: str, query_vector: list[float], templates: list[str] | None = None, limit: int = 10, least: float = 0.55) -> DataFrame:
    """(id, label, template_id, score, of_template): the best nodes of enabled sources and some templates, each with how many of its template are among them."""
    wanted = nodes if templates is None else nodes.where(F.col("template_id").isin(*templates))
    hits = hybrid_hits(wanted.select("id", "label", F.lit("").alias("text")), vectors, text, query_vector, least)
    best = in_enabled_sources(wanted.join(hits, "id"), sources).orderBy(F.desc("score"), "id").limit(limit)
    return best.select("id", "label", "template_id", "score", F.count("*").over(Window.partitionBy("template_id")).alias("of_template"))


@query("search_nodes", sql(f"""WITH {bm25_sql("SELECT id, label, '' AS text FROM nodes WHERE template_id IN ('part', 'customer')", ["blue", "ring"])}, k AS (SELECT id, score / (1 + score) AS score FROM bm UNION ALL SELECT * FROM ({_NODE_NEAR}) WHERE score >= 0.2), h AS (SELECT id, max(score) AS score FROM k GROUP BY 1),
  best AS (SELECT n.id, n.label, n.template_id, h.score FROM h JOIN nodes n ON n.id = h.id AND n.template_id IN ('part', 'customer') LEFT JOIN sources s ON s.source_id = n.source_id WHERE n.source_id IS NULL OR s.enabled ORDER BY h.score DESC, n.id LIMIT 60) SELECT id, label, template_id, round(score, 5) AS score, count(*) OVER (PARTITION BY template_id) AS of_template FROM best"""))
def search_nodes(spark, d):
    found = search_nodes_by(m.nodes(spark, d), m.sources(spark, d), _node_vectors(spark, d), "blue ring", _query_vector(spark, d), ["part", "customer"], 60, 0.2)
    return found.withColumn("score", F.round("score", 5))


def search_chunks_by(chunks: DataFrame, vectors: DataFrame, text: str, query_vector: list[float], scope: list | None = None, limit: int = 10, least: float = 0.55) -> DataFrame:
    """(chunk_id, doc_id, score): the best chunks of some sources."""
    wanted = chunks if scope is None else chunks.where(F.col("source_id").isin(*scope))
    hits = hybrid_hits(wanted.select(F.col("chunk_id").alias("id"), F.lit("").alias("label"), F.col("content").alias("text")), vectors, text, query_vector, least)
    return wanted.join(hits, wanted.chunk_id == hits.id).orderBy(F.desc("score"), "chunk_id").limit(limit).select("chunk_id", "doc_id", "score")


def _chunk_sql(where: str, terms: list[str], least: float, limit: int) -> str:
    rows = f"SELECT chunk_id AS id, '' AS label, content AS text FROM chunks WHERE {where}"
    return f"""{bm25_sql(rows, terms)}, k AS (SELECT id, score / (1 + score) AS score FROM bm UNION ALL SELECT * FROM ({_CHUNK_NEAR}) WHERE score >= {least}), h AS (SELECT id, max(score) AS score FROM k GROUP BY 1),
  chunk_hits AS (SELECT c.chunk_id, c.doc_id, h.score FROM h JOIN chunks c ON c.chunk_id = h.id WHERE {where} ORDER BY h.score DESC, c.chunk_id LIMIT {limit})"""


@query("search_chunks", sql(f"WITH {_chunk_sql('true', ['licensed', 'onreen'], 0.2, 30)} SELECT chunk_id, doc_id, round(score, 5) AS score FROM chunk_hits"))
def search_chunks(spark, d):
    return search_chunks_by(m.chunks(spark, d), _chunk_vectors(spark, d), "licensed onreen", _query_vector(spark, d), None, 30, 0.2).withColumn("score", F.round("score", 5))


def rerank(hits: DataFrame, query_text: str) -> DataFrame:
    """Hits (id, text, score) again by the share of query words they hold, then by score."""
    wanted = F.array(*[F.lit(w) for w in sorted(set(query_text.lower().split()))])
    share = F.size(F.array_intersect(words("text"), wanted)) / F.size(wanted)
    return hits.select("id", "score", share.alias("overlap")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("overlap"), F.desc("score"), "id")))


@query("rerank", f"{_BM25}, top AS (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20) SELECT id, CAST(row_number() OVER (ORDER BY o DESC, score DESC, id) AS INTEGER) AS rank FROM (SELECT t.id, t.score, len(list_intersect(list_distinct(regexp_extract_all(lower(x.text), '[\\p{{L}}\\p{{N}}]+')), ['the', 'of', 'thing'])) AS o FROM top t JOIN documents x ON x.doc_id = t.id)")
def rerank_query(spark, d):
    top = _keyword(spark, d).orderBy(F.desc("score"), "id").limit(20)
    texts = m.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return rerank(texts.join(F.broadcast(top), "id"), "the of thing").select("id", "rank")


@query("graphrag_seed", f"SELECT id, round(score, 6) AS score FROM (SELECT * FROM {_SEMANTIC}) WHERE score >= 0.3 ORDER BY score DESC, id LIMIT 15")
def graphrag_seed(spark, d):
    return _vector(spark, d, 15, 0.3).select("id", F.round("score", 6).alias("score"))


def context_triples(edges: DataFrame, nodes: DataFrame, tops: DataFrame, limit: int = 200) -> DataFrame:
    """Triples of labels between the twenty best nodes of ``tops`` (id, score), the best pairs first."""
    t = tops.orderBy(F.desc("score"), "id").limit(20).select("id", "score")
    a, b = t.select(F.col("id").alias("src"), F.col("score").alias("s1")), t.select(F.col("id").alias("dst"), F.col("score").alias("s2"))
    names = nodes.select("id", "label")
    met = edges.select("src", "dst", "template_id").join(F.broadcast(a), "src", "left_semi").join(F.broadcast(b), "dst", "left_semi")  # twenty rows
    hits = met.distinct().join(F.broadcast(a), "src").join(F.broadcast(b), "dst")
    best = hits.orderBy(F.desc(F.col("s1") + F.col("s2")), "src", "dst", "template_id").limit(limit)
    named = names.select(F.col("id").alias("src"), F.col("label").alias("subject")).join(F.broadcast(best), "src")  # behind the limit
    return names.select(F.col("id").alias("dst"), F.col("label").alias("object")).join(F.broadcast(named), "dst").select("subject", F.col("template_id").alias("relation"), "object")


def context_text(triples: DataFrame, most: int = 4_000) -> str:
    """The triples a line each, as many as ``most`` characters hold, and how many are left out."""
    lines = [f"{r.subject} {r.relation} {r.object}" for r in triples.collect()]  # two hundred at most
    kept, size = [], 0
    for line in lines:
        if size + len(line) + 1 > most:
            break
        kept.append(line)
        size += len(line) + 1
    left = len(lines) - len(kept)
    return "\n".join([*kept, *([f"... and {left} more"] if left else [])])


def neighbour_triples(edges: DataFrame, nodes: DataFrame, tops: DataFrame, limit: int = 200, most: int = 4_000) -> DataFrame:
    """(place, src, subject, relation, dst, object, line, shown): each triple once that a node of ``tops`` (id, place) is an end of, the first node's first and those it is the subject of before others.

    An end that is no node has its id as label. ``line`` is the triple as text, with its ends' templates, ``shown`` whether it is in the summary: all lines are if they come to ``most`` characters, else
    those that end, with their break, within them.
    """
    a, b = F.broadcast(tops.select(F.col("id").alias("src"), (2 * F.col("place")).alias("_a"))), F.broadcast(tops.select(F.col("id").alias("dst"), (2 * F.col("place") + 1).alias("_b")))  # as few as tops
    met = edges.select("src", "dst", "template_id").join(a, "src", "left").join(b, "dst", "left").where("_a is not null or _b is not null")
    at = F.least("_a", "_b")  # of those that there are
    best = met.groupBy("src", "dst", "template_id").agg(F.min(at).alias("at")).orderBy("at", "template_id", "src", "dst").limit(limit)
    best = materialise(best.withColumn("place", F.row_number().over(Window.orderBy("at", "template_id", "src", "dst")).cast("bigint")), "triples")
    ends = best.select(F.col("src").alias("id")).unionByName(best.select(F.col("dst").alias("id"))).distinct()
    names = materialise(nodes.select("id", "label", "template_id").join(F.broadcast(ends), "id", "left_semi"), "names")  # behind the limit
    named = best.select("place", "src", "dst", F.col("template_id").alias("relation"))
    text = {}
    for end, as_ in (("src", "subject"), ("dst", "object")):
        named = named.join(names.select(F.col("id").alias(end), F.col("label").alias(as_), F.col("template_id").alias(f"_{as_}")), end, "left").withColumn(as_, F.coalesce(as_, end))
        text[as_] = F.concat(as_, F.coalesce(F.concat(F.lit(" ("), f"_{as_}", F.lit(")")), F.lit("")))
    lines = named.withColumn("line", F.concat(text["subject"], F.lit(" "), "relation", F.lit(" "), text["object"], F.lit(".")))
    length = F.length("line") + 1
    shown = (F.sum(length).over(Window.orderBy("place")) <= most) | (F.sum(length).over(Window.partitionBy()) - 1 <= most)  # of two hundred rows
    return lines.select("place", "src", "subject", "relation", "dst", "object", "line", shown.alias("shown"))


def provenance(citations: DataFrame, tops: DataFrame, limit: int = 50) -> DataFrame:
    """(chunk_id, score): chunks that cite top entities, the best entity's first."""
    hits = citations.join(tops.select(F.col("id").alias("entity_uri"), "score"), "entity_uri")
    return hits.groupBy("chunk_id").agg(F.max("score").alias("best")).orderBy(F.desc("best"), "chunk_id").limit(limit).select("chunk_id", F.lit(1.0).alias("score"))


@query("graphrag_provenance", sql("SELECT DISTINCT chunk_id, CAST(1.0 AS DOUBLE) AS score FROM citations WHERE entity_uri IN ('p:1', 'p:2', 'p:3') ORDER BY chunk_id LIMIT 50"))
def graphrag_provenance(spark, d):
    tops = spark.createDataFrame([("p:1", 1.0), ("p:2", 1.0), ("p:3", 1.0)], "id string, score double")
    return provenance(m.citations(spark, d), tops)


_SCOPE = ["src1", "src2", "src3", "src4", "src5"]
_SCOPE_SQL = "source_id IN ('src1', 'src2', 'src3', 'src4', 'src5')"


@query("graphrag_vector_chunks", sql(f"WITH {_chunk_sql(_SCOPE_SQL, ['thing', 'hahaha'], 0.1, 20)} SELECT chunk_id, doc_id, round(score, 5) AS score FROM chunk_hits"))
def graphrag_vector_chunks(spark, d):
    """Twice ten chunks of some sources."""
    return search_chunks_by(m.chunks(spark, d), _chunk_vectors(spark, d), "thing hahaha", _query_vector(spark, d), _SCOPE, 20, 0.1).withColumn("score", F.round("score", 5))


def fuse(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """Chunks of two lists (id, score) by reciprocal ranks, with origin and aliases C0, C1, ..."""
    both = first.select(F.lit("provenance").alias("list"), "id", "score").unionByName(second.select(F.lit("vector").alias("list"), "id", "score"))
    ranked = ranks(both)
    origin = F.when(F.count_distinct("list") == 2, "both").otherwise(F.min("list"))
    fused = rrf(ranked).join(ranked.groupBy("id").agg(origin.alias("origin")), "id").orderBy(F.desc("score"), "id").limit(limit)
    return fused.withColumn("alias", F.concat(F.lit("C"), F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1))


@query("graphrag_fuse", """WITH l AS (SELECT 'provenance' AS list, vec_id AS id, row_number() OVER (ORDER BY label DESC, vec_id) AS rank FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 'vector', vec_id, row_number() OVER (ORDER BY vec_id % 29 DESC, vec_id) FROM embeddings WHERE vec_id % 3 = 0),
  f AS (SELECT id, sum(1.0 / (60 + rank)) AS score, CASE WHEN count(DISTINCT list) = 2 THEN 'both' ELSE min(list) END AS origin FROM l GROUP BY id ORDER BY score DESC, id LIMIT 20) SELECT id, round(score, 8) AS score, origin, 'C' || (row_number() OVER (ORDER BY score DESC, id) - 1) AS alias FROM f""")
def graphrag_fuse(spark, d):
    e = m.table(spark, d, "embeddings")
    a = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("score"))
    b = e.where("vec_id % 3 = 0").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 29).alias("score"))
    return fuse(a, b, 20).select("id", F.round("score", 8).alias("score"), "origin", "alias")


@query("knowledge_gaps", sql(f"WITH {bm25_sql(_NODE_ROWS, ['ring', 'green'])}, n AS (SELECT id FROM bm ORDER BY score DESC, id LIMIT 20) SELECT n.id, count(e.id) AS connections FROM n LEFT JOIN (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) e ON e.id = n.id GROUP BY n.id"))
def knowledge_gaps(spark, d):
    """Hits of a search with how connected they are."""
    nodes = m.nodes(spark, d).select("id", "label", F.lit("").alias("text"))
    hits = keyword(nodes, ["ring", "green"], FIELDS, "id").orderBy(F.desc("score"), "id").limit(20).select("id")
    degree = endpoints(m.edges(spark, d)).join(F.broadcast(hits), "id", "left_semi").groupBy("id").agg(F.count("*").alias("connections"))  # twenty ids
    return hits.join(degree, "id", "left").na.fill(0)


@query("topic_research", f"{_BM25} SELECT id, round(score, 5) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 5")
def topic_research(spark, d):
    return _keyword(spark, d).orderBy(F.desc("score"), "id").limit(5).select("id", F.round("score", 5).alias("score"))


@query("index_build", "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark) GROUP BY 1, 2) GROUP BY term")
def index_build(spark, d):
    """Written twice, so replaced once, and read back."""
    path = scratch_path(spark, "index")
    for rows in (m.table(spark, d, "benchmark").limit(3), m.table(spark, d, "benchmark")):
        build_index(rows, {"text": 1.0}, path, "item_id", stemmed=False)
    return spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("bigint").alias("cf"))


@query("index_reconcile_sweep", sql("SELECT source_id FROM sources WHERE status <> 'pending' AND source_id NOT IN (SELECT source_id FROM chunks_indexed)".replace("chunks_indexed", "(SELECT DISTINCT CAST(label AS INTEGER) AS source_id FROM embeddings)")))
def index_reconcile_sweep(spark, d):
    """Sources that should be in the index and aren't."""
    indexed = m.table(spark, d, "embeddings").select(F.col("label").alias("source_id")).distinct()
    return m.sources(spark, d).where("status <> 'pending'").join(indexed, "source_id", "left_anti").select("source_id")
