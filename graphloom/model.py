"""The property graph and its side tables, derived from the star-schema tables.

Nodes are customers, suppliers, parts, nations and regions; their source is a nation. Some refer to
a source that doesn't exist, some edges to nodes that don't: what referential checks have to find.
``SQL`` says the same in SQL, for comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.spread import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    none = F.lit(None).cast("int")
    lost = F.when(F.col("c_custkey") % 97 == 0, 999).otherwise(F.col("c_nationkey"))
    parts = [
        t("customer").select(_id("c", "c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit("customer").alias("template_id"), lost.alias("source_id"), F.col("c_acctbal").alias("weight")),
        t("supplier").select(_id("s", "s_suppkey"), "s_name", F.lit("supplier"), "s_nationkey", "s_acctbal"),
        t("part").select(_id("p", "p_partkey"), "p_name", F.lit("part"), none, "p_retailprice"),
        t("nation").select(_id("n", "n_nationkey"), "n_name", F.lit("nation"), "n_nationkey", F.lit(0.0)),
        t("region").select(_id("r", "r_regionkey"), "r_name", F.lit("region"), none, F.lit(0.0)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        k.alias("source_id"),
        F.concat(F.lower("n_name"), F.lit(".txt")).alias("filename"),
        F.when(k % 3 != 0, F.concat(F.lit("Report on "), F.col("n_name"))).alias("title"),
        F.when(k % 4 != 0, F.element_at(F.array(F.lit("pdf"), F.lit("text"), F.lit("html")), k % 3 + 1)).alias("source_type"),
        (k % 5 != 0).alias("enabled"),
        F.element_at(F.array(F.lit("pending"), F.lit("indexed"), F.lit("committed"), F.lit("error")), k % 4 + 1).alias("status"),
        F.concat(F.lit("https://example.org/"), F.lower("n_name")).alias("origin_url"),
        (F.lit(20240101) + k).alias("created_day"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    pick = lambda df, a, b, kind, source: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("template_id"), source.cast("int").alias("source_id"))
    none = F.lit(None)
    n = t("lineitem").count()  # read from the files' footers
    ordered = spread(t("orders").select("o_orderkey", "o_custkey"), n, "o_orderkey").join(spread(t("lineitem").select("l_orderkey", "l_partkey"), n, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    bought = spread(ordered.select("o_custkey", "l_partkey"), n, "o_custkey", "l_partkey").distinct()
    supplied = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    nation = t("nation")
    out = pick(t("customer"), _id("c", "c_custkey"), _id("n", "c_nationkey"), "located_in", F.col("c_nationkey"))
    for more in (
        pick(t("supplier"), _id("s", "s_suppkey"), _id("n", "s_nationkey"), "located_in", F.col("s_nationkey")),
        pick(nation, _id("n", "n_nationkey"), _id("r", "n_regionkey"), "part_of", F.col("n_nationkey")),
        pick(bought, _id("c", "o_custkey"), _id("p", "l_partkey"), "bought", none),
        pick(supplied, _id("p", "l_partkey"), _id("s", "l_suppkey"), "supplied_by", none),
        pick(nation.where("n_nationkey % 6 = 0"), _id("n", "n_nationkey"), _id("x", "n_nationkey"), "refers_to", F.col("n_nationkey")),
        pick(nation.where("n_nationkey % 2 = 0"), _id("n", "n_nationkey"), F.concat(F.lit("n:"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("string")), "trades_with", none),
    ):
        out = out.union(more)
    return out


def small_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where(F.col("template_id").isin("nation", "region", "supplier"))


def small_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, regions and suppliers, with trade between nations so that there are cycles."""
    t = lambda n: table(spark, sf_dir, n)
    k = F.col("n_nationkey")
    return (
        t("nation").where(k % 2 == 0).select(_id("n", "n_nationkey").alias("src"), F.concat(F.lit("n:"), ((k * 7 + 3) % 25).cast("string")).alias("dst"), F.lit("trades_with").alias("template_id"))
        .union(t("nation").select(_id("n", "n_nationkey"), _id("r", "n_regionkey"), F.lit("part_of")))
        .union(t("supplier").select(_id("s", "s_suppkey"), _id("n", "s_nationkey"), F.lit("located_in")))
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity citations: a line item cites its part in a chunk of a source."""
    return table(spark, sf_dir, "lineitem").select(
        _id("p", "l_partkey").alias("entity_uri"),
        (F.col("l_suppkey") % 25).cast("int").alias("source_id"),
        (F.col("l_orderkey") % 500).alias("chunk_id"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"),
        F.col("l_returnflag").alias("extraction_method"),
        F.when(F.col("l_linenumber") != 7, F.col("l_linestatus")).alias("entity_type"),
        F.col("l_shipdate").alias("created_at"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("citation_id"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents; ids leave room for sixteen million of each."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    return d.select((F.col("doc_id") * 16777216 + F.col("chunk_index")).alias("chunk_id"), "doc_id", F.col("source").alias("source_id"), "chunk_index", "content")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted entities: parts, twenty-five sources of them."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("ordinal"), (k % 25).cast("int").alias("source_id"), F.col("p_name").alias("name"),
        F.when(k % 11 != 0, F.col("p_type")).alias("type"),
        (F.col("p_size") * 6).alias("description_length"),
        F.round((k % 100) / 100.0, 2).alias("confidence"),
        (k % 7).cast("int").alias("n_chunks"), (k % 9).cast("int").alias("n_properties"), (k % 4).cast("int").alias("n_aliases"),
        F.col("p_brand").alias("brand"),
    )


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted relationships between entities of one source."""
    n = "l_partkey"
    other = (F.col("l_suppkey") * 25 + F.col(n) % 25)
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal"), (F.col(n) % 25).cast("int").alias("source_id"),
        F.col(n).alias("source"), other.alias("target"),
        F.element_at(F.array(F.lit("uses"), F.lit("owns"), F.lit("near"), F.lit("part_of")), (F.col("l_linenumber") % 4 + 1)).alias("type"),
        F.round(1 - 5 * F.col("l_discount"), 2).alias("confidence"),
        F.col("l_quantity").cast("int").alias("justification_length"), (F.col("l_linenumber") % 3).alias("n_refs"), (F.col("l_orderkey") % 6).cast("int").alias("chunk_index"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per model call, from the events."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("id"), (F.col("user_id") % 25).cast("int").alias("source_id"), "ts", F.to_date("ts").alias("day"),
        F.element_at(F.array(F.lit("large-v2"), F.lit("large"), F.lit("small-2024"), F.lit("free")), (F.col("user_id") % 4 + 1).cast("int")).alias("model"),
        F.when(F.col("user_id") % 2 == 0, "alpha").otherwise("beta").alias("provider"),
        ((e * 37) % 2000).alias("input_tokens"), ((e * 11) % 500).alias("output_tokens"),
        F.floor(F.col("value") * 10).cast("bigint").alias("duration_ms"), (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "error", F.element_at(F.array(F.lit("timeout"), F.lit("rate_limit"), F.lit("parse")), (e % 3 + 1).cast("int"))).alias("error_type"),
        (e % 7 == 0).alias("was_retry"), "event_type", "value", "user_id", "props",
    )


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, sentences): the lines of each document that aren't blank; a document is a source."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select(F.col("doc_id").alias("source_id"), F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("sentences"))


def _drawn(spark: SparkSession, sf_dir: str, many: int, **picks) -> DataFrame:
    """Documents of twelve words or more, each ``many`` times with a running number i from 0; ``picks`` name words by their places from k and i.

    Words are picked before rows are made, so a document's words are held once.
    """
    found = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)) if picks else None
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), *([found.alias("w")] if picks else ["text"]))
    d = d.where(F.size("w") >= 12) if picks else d.where(F.regexp_count("text", F.lit("[A-Za-z]+")) >= 12)
    drawn = lambda i: F.struct(i.alias("i"), *[F.get("w", F.pmod(at(F.col("k"), i), F.size("w")).cast("int")).alias(n) for n, at in picks.items()])
    return d.select("k", F.explode(F.transform(F.sequence(F.lit(0), F.lit(many - 1)), drawn)).alias("x")).select("k", "x.*")


# References to sentences as models write them, sound, out of range, repairable and missing.
REFERENCES = ("S1", "S1-S3", "S2,S1", "S900000", "S1 to S2", "s2", "first line")


def _picked(values: tuple, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(at, F.lit(len(values))).cast("int"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities as a model would extract them: eight of each document, some structural, generic, junk or ungrounded."""
    k, i = F.col("k"), F.col("i")
    name = (
        F.when(i == 7, F.concat(F.lit("Chapter "), k % 30)).when((i == 6) & (k % 5 == 0), "the").when(i == 5, F.col("first"))
        .otherwise(F.concat("given", F.lit(" "), "family"))
    )
    kind = _picked(("Person", "Place", "Item", "Title", "person", "Unknown", "Object"), k + i)
    text = F.when((k + i) % 3 == 0, F.concat(F.lit("A place near "), "near")).when((k + i) % 3 == 1, F.concat(F.lit("Someone called "), "called"))
    drawn = _drawn(
        spark, sf_dir, 8, first=lambda k, i: k * 7, given=lambda k, i: k * 7 + i * 13, family=lambda k, i: k * 3 + i * 5, other=lambda k, i: k * 5 + i * 3,
        near=lambda k, i: k + i, called=lambda k, i: k * 2 + i,
    )
    return drawn.select(
        k.alias("source_id"), (i % 3).cast("int").alias("chunk_index"), (k * 8 + i).alias("ordinal"), name.alias("name"), kind.alias("type"),
        F.when(i % 2 == 0, F.array("other")).otherwise(F.array().cast("array<string>")).alias("aliases"),
        text.alias("description"), F.when((k + i) % 9 != 8, _picked(REFERENCES, k + i * 2)).alias("sent_ref"), F.round(((k * 37 + i * 11) % 100) / 100, 2).alias("confidence"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships as a model would extract them: ten between the entities of each document, self loops and odd types among them."""
    k, i = F.col("k"), F.col("i")
    types = ("works_for", "lives_in", "lives_in_city", "works", "totally_unknown", "owner_of", "located_in")
    return _drawn(spark, sf_dir, 10).select(
        k.alias("source_id"), (i % 3).cast("int").alias("chunk_index"), (k * 10 + i).alias("ordinal"), (k * 8 + i % 7).alias("source"),
        (k * 8 + F.when((k + i) % 11 == 0, i % 7).otherwise((i * 3 + 1) % 8)).alias("target"), _picked(types, k + i).alias("type"),
        _picked(REFERENCES, k * 2 + i).alias("sent_ref"), F.round(((k * 53 + i * 17) % 100) / 100, 2).alias("confidence"),
    )


_REFS = "[" + ", ".join(f"'{r}'" for r in REFERENCES) + "]"
_DRAWN = "(SELECT *, len(w) AS n, unnest(range({many})) AS i FROM (SELECT doc_id AS k, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents) WHERE len(w) >= 12)"

# Tables above in SQL, by name.
SQL = {
    "sentences": "SELECT doc_id AS source_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS sentences FROM documents WHERE text IS NOT NULL",
    "mentions": f"""SELECT k AS source_id, CAST(i % 3 AS INTEGER) AS chunk_index, k * 8 + i AS ordinal, CASE WHEN i = 7 THEN 'Chapter ' || (k % 30) WHEN i = 6 AND k % 5 = 0 THEN 'the' WHEN i = 5 THEN w[(k * 7) % n + 1] ELSE w[(k * 7 + i * 13) % n + 1] || ' ' || w[(k * 3 + i * 5) % n + 1] END AS name,
      ['Person', 'Place', 'Item', 'Title', 'person', 'Unknown', 'Object'][(k + i) % 7 + 1] AS type, CASE WHEN i % 2 = 0 THEN [w[(k * 5 + i * 3) % n + 1]] ELSE CAST([] AS VARCHAR[]) END AS aliases,
      CASE (k + i) % 3 WHEN 0 THEN 'A place near ' || w[(k + i) % n + 1] WHEN 1 THEN 'Someone called ' || w[(k * 2 + i) % n + 1] END AS description,
      CASE WHEN (k + i) % 9 <> 8 THEN {_REFS}[(k + i * 2) % 7 + 1] END AS sent_ref, round(((k * 37 + i * 11) % 100) / 100.0, 2) AS confidence FROM {_DRAWN.format(many=8)}""",
    "claims": f"""SELECT k AS source_id, CAST(i % 3 AS INTEGER) AS chunk_index, k * 10 + i AS ordinal, k * 8 + i % 7 AS source, k * 8 + CASE WHEN (k + i) % 11 = 0 THEN i % 7 ELSE (i * 3 + 1) % 8 END AS target,
      ['works_for', 'lives_in', 'lives_in_city', 'works', 'totally_unknown', 'owner_of', 'located_in'][(k + i) % 7 + 1] AS type, {_REFS}[(k * 2 + i) % 7 + 1] AS sent_ref, round(((k * 53 + i * 17) % 100) / 100.0, 2) AS confidence FROM {_DRAWN.format(many=10)}""",
    "nodes": """SELECT 'c:' || c_custkey AS id, c_name AS label, 'customer' AS template_id, CASE WHEN c_custkey % 97 = 0 THEN 999 ELSE c_nationkey END AS source_id, c_acctbal AS weight FROM customer
      UNION ALL SELECT 's:' || s_suppkey, s_name, 'supplier', s_nationkey, s_acctbal FROM supplier
      UNION ALL SELECT 'p:' || p_partkey, p_name, 'part', NULL, p_retailprice FROM part
      UNION ALL SELECT 'n:' || n_nationkey, n_name, 'nation', n_nationkey, 0.0 FROM nation
      UNION ALL SELECT 'r:' || r_regionkey, r_name, 'region', NULL, 0.0 FROM region""",
    "sources": """SELECT n_nationkey AS source_id, lower(n_name) || '.txt' AS filename, CASE WHEN n_nationkey % 3 <> 0 THEN 'Report on ' || n_name END AS title,
      CASE WHEN n_nationkey % 4 <> 0 THEN ['pdf', 'text', 'html'][n_nationkey % 3 + 1] END AS source_type, n_nationkey % 5 <> 0 AS enabled,
      ['pending', 'indexed', 'committed', 'error'][n_nationkey % 4 + 1] AS status, 'https://example.org/' || lower(n_name) AS origin_url, 20240101 + n_nationkey AS created_day FROM nation""",
    "edges": """SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst, 'located_in' AS template_id, c_nationkey AS source_id FROM customer
      UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'located_in', s_nationkey FROM supplier
      UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'part_of', n_nationkey FROM nation
      UNION ALL SELECT DISTINCT 'c:' || o_custkey, 'p:' || l_partkey, 'bought', CAST(NULL AS INTEGER) FROM orders JOIN lineitem ON o_orderkey = l_orderkey
      UNION ALL SELECT DISTINCT 'p:' || l_partkey, 's:' || l_suppkey, 'supplied_by', CAST(NULL AS INTEGER) FROM lineitem
      UNION ALL SELECT 'n:' || n_nationkey, 'x:' || n_nationkey, 'refers_to', n_nationkey FROM nation WHERE n_nationkey % 6 = 0
      UNION ALL SELECT 'n:' || n_nationkey, 'n:' || ((n_nationkey * 7 + 3) % 25), 'trades_with', CAST(NULL AS INTEGER) FROM nation WHERE n_nationkey % 2 = 0""",
    "small_nodes": "SELECT * FROM nodes WHERE template_id IN ('nation', 'region', 'supplier')",
    "small_edges": """SELECT 'n:' || n_nationkey AS src, 'n:' || ((n_nationkey * 7 + 3) % 25) AS dst, 'trades_with' AS template_id FROM nation WHERE n_nationkey % 2 = 0
      UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'part_of' FROM nation
      UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'located_in' FROM supplier""",
    "citations": """SELECT 'p:' || l_partkey AS entity_uri, CAST(l_suppkey % 25 AS INTEGER) AS source_id, l_orderkey % 500 AS chunk_id, round(1 - l_discount, 2) AS confidence,
      l_returnflag AS extraction_method, CASE WHEN l_linenumber <> 7 THEN l_linestatus END AS entity_type, l_shipdate AS created_at, l_orderkey * 8 + l_linenumber AS citation_id FROM lineitem""",
    "chunks": """SELECT doc_id * 16777216 + i - 1 AS chunk_id, doc_id, source AS source_id, CAST(i - 1 AS INTEGER) AS chunk_index, lines[i] AS content FROM
      (SELECT doc_id, source, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents))""",
    "entities": """SELECT p_partkey AS ordinal, CAST(p_partkey % 25 AS INTEGER) AS source_id, p_name AS name, CASE WHEN p_partkey % 11 <> 0 THEN p_type END AS type, p_size * 6 AS description_length,
      round((p_partkey % 100) / 100.0, 2) AS confidence, CAST(p_partkey % 7 AS INTEGER) AS n_chunks, CAST(p_partkey % 9 AS INTEGER) AS n_properties, CAST(p_partkey % 4 AS INTEGER) AS n_aliases, p_brand AS brand FROM part""",
    "relationships": """SELECT l_orderkey * 8 + l_linenumber AS ordinal, CAST(l_partkey % 25 AS INTEGER) AS source_id, l_partkey AS source, l_suppkey * 25 + l_partkey % 25 AS target,
      ['uses', 'owns', 'near', 'part_of'][l_linenumber % 4 + 1] AS type, round(1 - 5 * l_discount, 2) AS confidence, CAST(l_quantity AS INTEGER) AS justification_length, l_linenumber % 3 AS n_refs,
      CAST(l_orderkey % 6 AS INTEGER) AS chunk_index FROM lineitem""",
    "metrics": """SELECT event_id AS id, CAST(user_id % 25 AS INTEGER) AS source_id, ts, CAST(ts AS DATE) AS day, ['large-v2', 'large', 'small-2024', 'free'][user_id % 4 + 1] AS model,
      CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS provider, (event_id * 37) % 2000 AS input_tokens, (event_id * 11) % 500 AS output_tokens, CAST(floor(value * 10) AS BIGINT) AS duration_ms,
      event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN ['timeout', 'rate_limit', 'parse'][event_id % 3 + 1] END AS error_type, event_id % 7 = 0 AS was_retry, event_type, value, user_id, props FROM events""",
}
_NEEDS = {"small_nodes": ["nodes"]}


def with_tables(body: str) -> str:
    """SQL that starts with those tables of ``SQL`` that ``body`` names."""
    import re

    used: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in used:
            used.append(name)

    for name in SQL:
        if re.search(rf"\b{name}\b", body):
            add(name)
    parts = [f"{n} AS ({SQL[n]})" for n in used]
    recursive = re.match(r"\s*WITH\s+(RECURSIVE\s+)?(.*)", body, re.S)
    if recursive:
        return f"WITH {recursive[1] or ''}{', '.join(parts)}{', ' if parts else ''}{recursive[2]}"
    return f"WITH {', '.join(parts)} {body}" if parts else body
