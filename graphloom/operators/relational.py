"""Filters, joins, set operations, sorts and pages over the graph's tables.

Functions take and return DataFrames; the queries below apply them to the tables of
:mod:`graphloom.model`. Ties are always broken by a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom import model as m
from graphloom.catalog import query
from graphloom.plans.scratch import few

SYSTEM_TEMPLATES = ("region",)


def sql(body: str) -> str:
    return m.with_tables(body)


# ---- filters -------------------------------------------------------------------------------


def in_enabled_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows without a source, or whose source exists and is enabled."""
    flags = sources.select(F.col("source_id").alias("_source"), F.col("enabled").alias("_enabled"))
    joined = rows.join(flags, rows.source_id == F.col("_source"), "left")
    return joined.where(F.col("source_id").isNull() | F.col("_enabled")).drop("_source", "_enabled")


def in_scope(nodes: DataFrame, scope: list[int]) -> DataFrame:
    """Nodes without a source or of a source in ``scope``."""
    return nodes.where(F.col("source_id").isNull() | F.col("source_id").isin(*scope))


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose endpoints are both among ``nodes``."""
    ids = nodes.select(F.col("id").alias("_id"))
    return edges.join(ids, edges.src == F.col("_id"), "left_semi").join(ids, edges.dst == F.col("_id"), "left_semi")


def fuzzy_template(rows: DataFrame, wanted: str) -> DataFrame:
    """Rows whose template holds ``wanted`` or is held by it, whatever the case."""
    t = F.lower("template_id")
    return rows.where(t.contains(wanted.lower()) | F.lit(wanted.lower()).contains(t))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of rows in order, each with the number of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


@query("proj_minimal", sql("SELECT id, label, template_id FROM nodes"))
def proj_minimal(spark, d):
    return m.nodes(spark, d).select("id", "label", "template_id")


@query("proj_no_embedding", "SELECT vec_id, label FROM embeddings")
def proj_no_embedding(spark, d):
    return m.table(spark, d, "embeddings").select("vec_id", "label")


@query("filter_template", sql("SELECT id, label FROM nodes WHERE template_id = 'supplier'"))
def filter_template(spark, d):
    return m.nodes(spark, d).where("template_id = 'supplier'").select("id", "label")


@query("filter_source_ids", sql("SELECT id, source_id FROM nodes WHERE source_id IN (3, 7, 999)"))
def filter_source_ids(spark, d):
    return m.nodes(spark, d).where(F.col("source_id").isin(3, 7, 999)).select("id", "source_id")


@query("filter_endpoint", sql("SELECT src, dst, template_id FROM edges WHERE src = 'c:7' OR dst = 'n:3'"))
def filter_endpoint(spark, d):
    return m.edges(spark, d).where("src = 'c:7' or dst = 'n:3'").select("src", "dst", "template_id")


@query("filter_enabled_source", sql("SELECT n.id, n.source_id FROM nodes n LEFT JOIN sources s ON n.source_id = s.source_id WHERE n.source_id IS NULL OR s.enabled"))
def filter_enabled_source(spark, d):
    return in_enabled_sources(m.nodes(spark, d), m.sources(spark, d)).select("id", "source_id")


@query("filter_null_embedding", "SELECT vec_id FROM embeddings WHERE embedding IS NULL OR len(embedding) = 0 OR vec_id % 50 = 0")
def filter_null_embedding(spark, d):
    e = m.table(spark, d, "embeddings")
    blanked = e.withColumn("embedding", F.when(F.col("vec_id") % 50 != 0, F.col("embedding")))
    return blanked.where(F.col("embedding").isNull() | (F.size("embedding") == 0)).select("vec_id")


@query("filter_ilike_search", sql("SELECT source_id, title FROM sources WHERE title ILIKE '%nation_1%' OR origin_url ILIKE '%NATION_2%'"))
def filter_ilike_search(spark, d):
    s = m.sources(spark, d)
    return s.where(F.col("title").ilike("%nation_1%") | F.col("origin_url").ilike("%NATION_2%")).select("source_id", "title")


@query("filter_scope", sql("""SELECT e.src, e.dst, e.template_id FROM edges e
  WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.id = e.src AND (n.source_id IS NULL OR n.source_id IN (1, 2, 3)))
    AND EXISTS (SELECT 1 FROM nodes n WHERE n.id = e.dst AND (n.source_id IS NULL OR n.source_id IN (1, 2, 3)))"""))
def filter_scope(spark, d):
    return between(m.edges(spark, d), in_scope(m.nodes(spark, d), [1, 2, 3])).select("src", "dst", "template_id")


@query("filter_template_fuzzy", sql("SELECT id FROM nodes WHERE contains(template_id, 'nation') OR contains('nation', template_id) OR contains(template_id, 'NATIONS')"))
def filter_template_fuzzy(spark, d):
    return fuzzy_template(m.nodes(spark, d), "Nation").select("id")


@query("filter_instr_title", sql("SELECT n.id, s.source_id FROM nodes n JOIN sources s ON n.template_id = 'nation' AND instr(s.title, n.label) > 0"))
def filter_instr_title(spark, d):
    n, s = m.nodes(spark, d).where("template_id = 'nation'"), m.sources(spark, d).select(F.col("source_id").alias("sid"), "title")
    # a title holds few words: exploding its prefixes and suffixes of words turns containment into an equi join
    words = s.select("sid", "title", F.explode(F.split("title", " ")).alias("word"))
    starts = words.select("sid", "title", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.substring("word", 1, k))).alias("piece"))
    return n.join(starts, n.label == starts.piece).select("id", F.col("sid").alias("source_id")).distinct()


@query("filter_unembedded_chunks", sql("SELECT source_id, count(*) AS missing FROM chunks WHERE chunk_id % 3 = 0 GROUP BY source_id"))
def filter_unembedded_chunks(spark, d):
    c = m.chunks(spark, d).withColumn("embedding", F.when(F.col("chunk_id") % 3 != 0, F.lit(1)))
    return c.where("embedding is null").groupBy("source_id").agg(F.count("*").alias("missing"))


@query("filter_event_trigger", sql("""WITH triggers AS (SELECT * FROM (VALUES (1, 'error', NULL), (2, NULL, 5), (3, 'view', 7), (4, NULL, NULL)) t(trigger_id, want_type, want_k))
  SELECT trigger_id, count(*) AS matched FROM triggers, (SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
  WHERE (want_type IS NULL OR want_type = event_type) AND (want_k IS NULL OR want_k = k) GROUP BY trigger_id"""))
def filter_event_trigger(spark, d):
    """A trigger fires if each key of its filter equals the event's value; unknown keys never do."""
    wanted = [(1, {"event_type": "error"}), (2, {"k": "5"}), (3, {"event_type": "view", "k": "7"}), (4, {})]
    triggers = spark.createDataFrame(wanted, "trigger_id int, filter map<string,string>")
    payload = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    ev = m.table(spark, d, "events").select(payload.alias("payload"))
    hit = F.forall(F.map_keys("filter"), lambda k: F.coalesce(F.col("payload")[k] == F.col("filter")[k], F.lit(False)))
    return ev.join(few(triggers), hit).groupBy("trigger_id").agg(F.count("*").alias("matched"))  # a trigger per row of a literal


@query("path_extract", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k, json_extract(props, '$.missing') IS NOT NULL AS found FROM events")
def path_extract(spark, d):
    return m.table(spark, d, "events").select(
        "event_id", F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(-1).cast("bigint")).alias("k"), F.get_json_object("props", "$.missing").isNotNull().alias("found")
    )


_CHECKED = [
    {"name": "count", "type": "integer", "required": True}, {"name": "share", "type": "float"}, {"name": "flag", "type": "boolean"}, {"name": "day", "type": "date"}, {"name": "at", "type": "datetime"},
    {"name": "home", "type": "url"}, {"name": "mail", "type": "email"}, {"name": "kind", "type": "enum", "values": ["view", "click"]}, {"name": "code", "type": "string", "pattern": "^[A-Z]-[0-9]+$"}, {"name": "note", "type": "text", "required": True},
]


@query("prop_validate", """WITH p AS (SELECT event_id, event_type, event_id % 4 AS a, event_id % 5 AS b, event_id % 7 AS c, user_id FROM events)
  SELECT event_id, array_to_string(list_filter([CASE WHEN a = 0 THEN 'count: not integer' WHEN a = 1 THEN 'count: required' END, CASE WHEN b = 0 THEN 'share: not float' END, CASE WHEN b = 1 THEN 'flag: not boolean' END, CASE WHEN c = 0 THEN 'day: not date' END, CASE WHEN c = 1 THEN 'at: not datetime' END,
    CASE WHEN c = 2 THEN 'home: not url' END, CASE WHEN c = 3 THEN 'mail: not email' END, CASE WHEN event_type NOT IN ('view', 'click') THEN 'kind: not enum' END, CASE WHEN user_id % 3 = 0 THEN 'code: not string' END, CASE WHEN user_id % 5 = 0 THEN 'note: required' END], lambda x: x IS NOT NULL), '; ') AS errors FROM p""")
def prop_validate(spark, d):
    """Errors of each row against a template of all ten types."""
    from graphloom.functions.properties import property_errors

    e, lit = F.col("event_id"), F.lit
    put = {
        "count": F.when(e % 4 == 0, F.concat(lit("x"), e)).when(e % 4 != 1, F.col("user_id").cast("string")), "share": F.when(e % 5 == 0, "1,5").otherwise("1.5e-3"), "flag": F.when(e % 5 == 1, "yes").otherwise("True"),
        "day": F.when(e % 7 == 0, "2024-02-30").otherwise("2024-02-29"), "at": F.when(e % 7 == 1, "noon").otherwise("2024-02-29T12:30:00"), "home": F.when(e % 7 == 2, "ftp://x").otherwise("https://a.b/c?d=1"), "mail": F.when(e % 7 == 3, "a@b").otherwise("a.b@c.de"),
        "kind": F.col("event_type"), "code": F.concat(F.when(F.col("user_id") % 3 == 0, "a-").otherwise("A-"), F.col("user_id")), "note": F.when(F.col("user_id") % 5 != 0, "any\ntext"),
    }
    pairs = [x for k, v in put.items() for x in (lit(k), v)]
    return m.table(spark, d, "events").select("event_id", F.array_join(property_errors(F.create_map(*pairs), _CHECKED), "; ").alias("errors"))


_LITERALS = (("True", True), ("False", False), ("None", False), ("0", False), ("0.0", False), ("-2", True), ("''", False), ("'x'", True), ("[]", False), ("[0]", True), ("{}", False), ("{'a': 1}", True), ("()", False), ("(1,)", True), ("not a literal (", False), ("", False))


@query("conditional", f"SELECT event_id, CASE WHEN [{', '.join(str(t).lower() for _, t in _LITERALS)}][event_id % {len(_LITERALS)} + 1] THEN event_type ELSE 'user ' || user_id END AS branch FROM events")
def conditional(spark, d):
    """One of two values by the truth of a literal, of every kind; what is none is false."""
    from graphloom.functions.properties import truthy

    raw = F.get(F.array(*[F.lit(x) for x, _ in _LITERALS]), (F.col("event_id") % len(_LITERALS)).cast("int"))
    return m.table(spark, d, "events").select("event_id", F.when(truthy(raw), F.col("event_type")).otherwise(F.concat(F.lit("user "), "user_id")).alias("branch"))


@query("loop", "SELECT doc_id, CAST(i - 1 AS INTEGER) AS iteration, w[i] AS item FROM (SELECT doc_id, w, unnest(range(1, least(len(w), 4) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))")
def loop(spark, d):
    """The first iterations over an array."""
    return m.table(spark, d, "documents").select("doc_id", F.posexplode(F.slice(F.split("text", " "), 1, 4)).alias("iteration", "item"))


_DEEP = """SELECT event_id, json_merge_patch(props::JSON, ('{"k2": ' || event_id || ', "deep": {"a": {"b": [1, ' || user_id || '], "c": {"d": "old"}}, "e": 1}}')::JSON, ('{"deep": {"a": {"b": ["' || event_type || '"], "c": {"f": ' || value || '}}, "e": {"g": true}}' || CASE WHEN event_id % 2 = 0 THEN ', "k": {"was": 1}' ELSE '' END || '}')::JSON) AS o FROM events"""


@query("merge_objects_deep", f"""SELECT event_id, json_extract_string(o, '$.k') AS k, CAST(json_extract_string(o, '$.k2') AS BIGINT) AS k2, json_extract_string(o, '$.deep.a.b[0]') AS b0, json_array_length(o, '$.deep.a.b') AS b_size,
  json_extract_string(o, '$.deep.a.c.d') AS d, round(CAST(json_extract_string(o, '$.deep.a.c.f') AS DOUBLE), 4) AS f, json_extract_string(o, '$.deep.e.g') AS g FROM ({_DEEP})""")
def merge_objects_deep(spark, d):
    """Deep merge of three objects: nested ones are merged, of other values the last one wins."""
    from graphloom.functions.properties import deep_merged

    e = m.table(spark, d, "events")
    second = F.concat(F.lit('{"k2": '), "event_id", F.lit(', "deep": {"a": {"b": [1, '), "user_id", F.lit('], "c": {"d": "old"}}, "e": 1}}'))
    third = F.concat(F.lit('{"deep": {"a": {"b": ["'), "event_type", F.lit('"], "c": {"f": '), F.col("value").cast("string"), F.lit('}}, "e": {"g": true}}'), F.when(F.col("event_id") % 2 == 0, ', "k": {"was": 1}').otherwise(""), F.lit("}"))
    o = e.select("event_id", deep_merged(deep_merged(F.parse_json("props"), F.parse_json(second)), F.parse_json(third)).alias("o"))
    get = lambda path, kind="string": F.try_variant_get("o", path, kind)
    return o.select(
        "event_id", get("$.k").alias("k"), get("$.k2", "bigint").alias("k2"), get("$.deep.a.b[0]").alias("b0"), F.size(get("$.deep.a.b", "array<variant>")).cast("bigint").alias("b_size"),
        get("$.deep.a.c.d").alias("d"), F.round(get("$.deep.a.c.f", "double"), 4).alias("f"), get("$.deep.e.g").alias("g"),
    )


@query("merge_objects", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'second' ELSE event_type END AS kind, CAST(user_id AS VARCHAR) AS who FROM events")
def merge_objects(spark, d):
    """Shallow merge of maps: the last one wins."""
    from graphloom.functions.properties import merge_maps

    e = F.col("event_id")
    a = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("who"), F.col("user_id").cast("string"))
    b = F.when(e % 2 == 0, F.create_map(F.lit("kind"), F.lit("second"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = m.table(spark, d, "events").select("event_id", merge_maps(a, b).alias("o"))
    return merged.select("event_id", F.col("o.kind").alias("kind"), F.col("o.who").alias("who"))


# ---- joins ---------------------------------------------------------------------------------


def with_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with label and template of both ends, null where an end doesn't exist."""
    side = lambda p: nodes.select(F.col("id").alias(f"_{p}"), F.col("label").alias(f"{p}_label"), F.col("template_id").alias(f"{p}_template"))
    a, b = side("src"), side("dst")
    return edges.join(a, edges.src == a["_src"], "left").join(b, edges.dst == b["_dst"], "left").drop("_src", "_dst")


def endpoints(edges: DataFrame) -> DataFrame:
    """(id, template_id): a row for each end of each edge, from one pass over the edges."""
    return edges.select("template_id", F.explode(F.array("src", "dst")).alias("id"))


@query("join_edge_nodes", sql("""SELECT e.src, e.dst, e.template_id, a.label AS src_label, b.label AS dst_label FROM edges e LEFT JOIN nodes a ON e.src = a.id LEFT JOIN nodes b ON e.dst = b.id WHERE e.template_id IN ('located_in', 'refers_to')"""))
def join_edge_nodes(spark, d):
    e = m.edges(spark, d).where(F.col("template_id").isin("located_in", "refers_to"))
    return with_nodes(e, m.nodes(spark, d)).select("src", "dst", "template_id", "src_label", "dst_label")


@query("join_rel_entities", sql("""SELECT r.ordinal, r.type, a.name AS source_name, b.name AS target_name FROM relationships r LEFT JOIN entities a ON r.source = a.ordinal LEFT JOIN entities b ON r.target = b.ordinal"""))
def join_rel_entities(spark, d):
    r, e = m.relationships(spark, d), m.entities(spark, d)
    a, b = e.select(F.col("ordinal").alias("ao"), F.col("name").alias("source_name")), e.select(F.col("ordinal").alias("bo"), F.col("name").alias("target_name"))
    return r.join(a, r.source == a.ao, "left").join(b, r.target == b.bo, "left").select("ordinal", "type", "source_name", "target_name")


@query("join_edges_same_source", sql("SELECT a.source_id, count(*) AS links FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id AND a.source_id = b.source_id GROUP BY a.source_id"))
def join_edges_same_source(spark, d):
    n, e = m.nodes(spark, d).where("source_id is not null"), m.edges(spark, d)
    a, b = n.select(F.col("id").alias("src"), F.col("source_id").alias("sa")), n.select(F.col("id").alias("dst"), F.col("source_id").alias("sb"))
    return e.select("src", "dst").join(a, "src").join(b, "dst").where("sa = sb").groupBy(F.col("sa").alias("source_id")).agg(F.count("*").alias("links"))


@query("join_edges_in_scope", sql("SELECT count(*) AS links FROM edges e JOIN nodes a ON e.src = a.id AND a.source_id IN (1, 2, 3, 4) JOIN nodes b ON e.dst = b.id AND b.source_id IN (1, 2, 3, 4)"))
def join_edges_in_scope(spark, d):
    inside = m.nodes(spark, d).where(F.col("source_id").isin(1, 2, 3, 4))
    return between(m.edges(spark, d), inside).agg(F.count("*").alias("links"))


_CITED = "SELECT c.citation_id, c.confidence, s.filename, c.chunk_id FROM citations c JOIN sources s ON c.source_id = s.source_id WHERE c.entity_uri = 'p:10'"


@query("join_citation_source_chunk", sql(f"SELECT *, (SELECT count(*) FROM ({_CITED})) AS total FROM ({_CITED} ORDER BY c.created_at DESC, c.citation_id LIMIT 20)"))
def join_citation_source_chunk(spark, d):
    c, s = m.citations(spark, d).where("entity_uri = 'p:10'"), m.sources(spark, d)
    joined = c.join(s, "source_id").select("citation_id", "confidence", "filename", "chunk_id", "created_at")
    return page(joined, [F.desc("created_at"), F.col("citation_id")], 0, 20).drop("created_at")


def tags(spark, d):
    """Sources by tag: a source has the tags of the sizes of its parts."""
    return m.table(spark, d, "part").select((F.col("p_partkey") % 25).cast("int").alias("source_id"), F.concat(F.lit("tag"), F.col("p_size") % 10).alias("tag")).distinct()


_TAGS = "(SELECT DISTINCT CAST(p_partkey % 25 AS INTEGER) AS source_id, 'tag' || (p_size % 10) AS tag FROM part)"


@query("join_tag_assignment", sql(f"SELECT s.source_id, string_agg(t.tag, ',' ORDER BY t.tag) AS tags FROM sources s JOIN {_TAGS} t ON s.source_id = t.source_id GROUP BY s.source_id"))
def join_tag_assignment(spark, d):
    joined = m.sources(spark, d).select("source_id").join(tags(spark, d), "source_id")
    return joined.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))


@query("semi_nodes_batch", sql("SELECT id, label FROM nodes WHERE id IN (SELECT 'p:' || l_partkey FROM lineitem WHERE l_returnflag = 'R')"))
def semi_nodes_batch(spark, d):
    wanted = m.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("p:"), "l_partkey").alias("id"))
    return m.nodes(spark, d).join(wanted, "id", "left_semi").select("id", "label")


@query("anti_orphan_edges_dst", sql("SELECT src, dst FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = e.dst)"))
def anti_orphan_edges_dst(spark, d):
    n = m.nodes(spark, d).select(F.col("id").alias("dst"))
    return m.edges(spark, d).join(n, "dst", "left_anti").select("src", "dst")


@query("anti_orphan_edges_src", sql("SELECT dst AS src, src AS dst FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = e.dst)"))
def anti_orphan_edges_src(spark, d):
    n = m.nodes(spark, d).select(F.col("id").alias("src"))
    return m.edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst")).join(n, "src", "left_anti").select("src", "dst")


@query("anti_orphan_nodes", sql("SELECT id FROM nodes n WHERE source_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sources s WHERE s.source_id = n.source_id)"))
def anti_orphan_nodes(spark, d):
    return m.nodes(spark, d).where("source_id is not null").join(m.sources(spark, d), "source_id", "left_anti").select("id")


@query("anti_orphan_templates", sql("SELECT DISTINCT template_id FROM edges WHERE template_id NOT IN (SELECT template_id FROM nodes)"))
def anti_orphan_templates(spark, d):
    return m.edges(spark, d).select("template_id").distinct().join(m.nodes(spark, d).select("template_id"), "template_id", "left_anti")


@query("set_orphan_entities", sql("SELECT DISTINCT entity_uri FROM citations WHERE confidence = 1 AND source_id = 3 AND entity_uri NOT IN (SELECT entity_uri FROM citations WHERE confidence = 1 AND source_id <> 3)"))
def set_orphan_entities(spark, d):
    """Entities that only source 3 cites for sure, by one aggregation instead of two scans."""
    by = m.citations(spark, d).where("confidence = 1").groupBy("entity_uri").agg(F.min("source_id").alias("low"), F.max("source_id").alias("high"))
    return by.where("low = 3 and high = 3").select("entity_uri")


@query("isolated_nodes", sql("SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM edges WHERE template_id NOT IN ('supplied_by', 'bought') UNION ALL SELECT dst FROM edges WHERE template_id NOT IN ('supplied_by', 'bought'))"))
def isolated_nodes(spark, d):
    """Nodes at no edge but trade."""
    return m.nodes(spark, d).join(endpoints(m.edges(spark, d).where("template_id not in ('supplied_by', 'bought')")), "id", "left_anti").select("id")


def delete_cascade(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of ``gone`` (id) and the edges at them."""
    ids = gone.select(F.col("id").alias("_id"))
    kept = edges.join(ids, edges.src == F.col("_id"), "left_anti").join(ids, edges.dst == F.col("_id"), "left_anti")
    return nodes.join(ids, nodes.id == F.col("_id"), "left_anti"), kept


def deletion_report(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> DataFrame:
    """(id, found, edges): for each id of ``gone`` whether there is such a node and how many edges at it go; a self loop is one edge."""
    wanted = gone.select("id").distinct()
    known = nodes.select("id").distinct().withColumn("found", F.lit(True))
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")).join(wanted, "id", "left_semi").groupBy("id").agg(F.count("*").alias("edges"))
    return wanted.join(known, "id", "left").join(ends, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"), F.when(F.col("found"), F.coalesce("edges", F.lit(0))).otherwise(0).cast("bigint").alias("edges"))


def _gone(spark, d) -> DataFrame:
    """Every third supplier and nation, and as many ids that no node has."""
    some = m.nodes(spark, d).where(F.col("template_id").isin("supplier", "nation") & (F.right("id", F.lit(1)).cast("int") % 3 == 0)).select("id")
    return some.unionByName(some.select(F.concat(F.lit("no "), "id").alias("id"))).unionByName(some)


_GONE = "g AS (SELECT id FROM nodes WHERE template_id IN ('supplier', 'nation') AND CAST(right(id, 1) AS INTEGER) % 3 = 0)"


@query("delete_cascade", sql(f"WITH {_GONE} SELECT template_id, count(*) AS edges_left FROM edges WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g) GROUP BY template_id"))
def delete_cascade_query(spark, d):
    return delete_cascade(m.nodes(spark, d), m.edges(spark, d), _gone(spark, d))[1].groupBy("template_id").agg(F.count("*").alias("edges_left"))


@query("delete_report", sql(f"WITH {_GONE}, c AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges WHERE src <> dst) GROUP BY id) SELECT g.id, true AS found, coalesce(n, 0) AS edges FROM g LEFT JOIN c ON c.id = g.id UNION ALL SELECT 'no ' || id, false, 0 FROM g"))
def delete_report(spark, d):
    """What a deletion takes along, and what it doesn't find."""
    return deletion_report(m.nodes(spark, d), m.edges(spark, d), _gone(spark, d))


def node_id(database: str, source: Column, template: Column, label: Column) -> Column:
    """Content-addressed id of a node."""
    key = F.concat_ws(":", F.lit(database), F.coalesce(source.cast("string"), F.lit("no_source")), template, F.lower(F.trim(label)))
    return F.concat(F.lit("node_"), F.substring(F.sha2(key, 256), 1, 24))


def upsert(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """(row, inserted): stored rows stay, of new rows with one key the first by ``order`` is inserted."""
    first = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    fresh = first.join(stored.select(key), key, "left_anti")
    return stored.withColumn("inserted", F.lit(False)).unionByName(fresh.withColumn("inserted", F.lit(True)), allowMissingColumns=True)


@query("upsert_nodes", sql("""WITH incoming AS (SELECT 'node_' || substr(sha256('db:' || coalesce(CAST(source_id AS VARCHAR), 'no_source') || ':' || template_id || ':' || lower(trim(label))), 1, 24) AS key, id, template_id FROM nodes),
  firsts AS (SELECT key, min(id) AS id, min(template_id) AS template_id FROM incoming GROUP BY key)
  SELECT template_id, count(*) FILTER (WHERE template_id <> 'nation') AS inserted_count, count(*) FILTER (WHERE template_id = 'nation') AS existing_count FROM firsts GROUP BY template_id"""))
def upsert_nodes(spark, d):
    keyed = m.nodes(spark, d).withColumn("key", node_id("db", F.col("source_id"), F.col("template_id"), F.col("label")))
    merged = upsert(keyed.where("template_id = 'nation'").dropDuplicates(["key"]), keyed, "key", "id")
    return merged.groupBy("template_id").agg(F.count_if("inserted").alias("inserted_count"), F.count_if(~F.col("inserted")).alias("existing_count"))


@query("upsert_edges", sql("""SELECT count(*) AS inserted_count FROM (SELECT DISTINCT substr(sha256('db:' || coalesce(CAST(source_id AS VARCHAR), 'no_source') || ':' || template_id || ':' || src || ':' || dst), 1, 24) AS key FROM edges)"""))
def upsert_edges(spark, d):
    e = m.edges(spark, d)
    key = F.substring(F.sha2(F.concat_ws(":", F.lit("db"), F.coalesce(F.col("source_id").cast("string"), F.lit("no_source")), "template_id", "src", "dst"), 256), 1, 24)
    e = e.withColumn("key", key)
    return upsert(e.limit(0), e.unionByName(e), "key", "src").agg(F.count_if("inserted").alias("inserted_count"))


@query("upsert_templates", sql("SELECT 'template_' || substr(sha256('db:' || lower(trim(name, ' '))), 1, 24) AS key, min(name) AS name, min(rank) = 1 AS inserted FROM (SELECT template_id AS name, 0 AS rank FROM nodes UNION ALL SELECT template_id, 1 FROM edges UNION ALL SELECT ' ' || upper(template_id), 1 FROM nodes) GROUP BY 1".replace("min(name) AS name", "arg_min(name, (rank, name)) AS name")))
def upsert_templates(spark, d):
    """Templates of edges, and those of nodes written otherwise, into those of nodes: a key that is there keeps its row."""
    key = lambda c: F.concat(F.lit("template_"), F.substring(F.sha2(F.concat(F.lit("db:"), F.lower(F.trim(c))), 256), 1, 24))
    named = lambda df, c: df.select(c.alias("name")).distinct().select(key(F.col("name")).alias("key"), "name")
    own = named(m.nodes(spark, d), F.col("template_id"))
    new = named(m.edges(spark, d), F.col("template_id")).unionByName(named(m.nodes(spark, d), F.concat(F.lit(" "), F.upper("template_id"))))
    return upsert(own, new, "key", "name").select("key", "name", "inserted")


@query("upsert_by_iri", sql("""SELECT coalesce(a.id, b.id) AS id, coalesce(b.label, a.label) AS label, a.id IS NULL AS created FROM (SELECT id, label FROM nodes WHERE template_id = 'supplier') a
  FULL JOIN (SELECT 's:' || (s_suppkey * 2) AS id, 'new ' || s_name AS label FROM supplier) b ON a.id = b.id"""))
def upsert_by_iri(spark, d):
    old = m.nodes(spark, d).where("template_id = 'supplier'").select("id", F.col("label").alias("a"))
    new = m.table(spark, d, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey") * 2).alias("id"), F.concat(F.lit("new "), "s_name").alias("b"))
    return old.join(new, "id", "full").select("id", F.coalesce("b", "a").alias("label"), F.col("a").isNull().alias("created"))


@query("cleanup_corrupt", sql("SELECT count(*) AS corrupt FROM nodes WHERE template_id = 'customer' AND CAST(substr(id, 3) AS BIGINT) % 13 = 0"))
def cleanup_corrupt(spark, d):
    """Nodes without a label or template."""
    n = m.nodes(spark, d).withColumn("label", F.when((F.col("template_id") == "customer") & (F.substring("id", 3, 20).cast("bigint") % 13 == 0), "").otherwise(F.col("label")))
    return n.where("label is null or trim(label) = '' or template_id is null").agg(F.count("*").alias("corrupt"))


@query("cleanup_orphans", sql("""SELECT (SELECT count(*) FROM edges) AS edges_scanned, (SELECT count(*) FROM edges WHERE src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes)) AS edges_removed,
  (SELECT count(*) FROM nodes) AS nodes_scanned, (SELECT count(*) FROM nodes WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM sources)) AS nodes_removed"""))
def cleanup_orphans(spark, d):
    """One pass: removing nodes can orphan edges only for the next run."""
    n, e = m.nodes(spark, d), m.edges(spark, d)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [count(e, "edges_scanned"), count(between(e, n), "edges_kept"), count(n, "nodes_scanned"), count(anti_orphan_nodes(spark, d), "nodes_removed")]
    one = reduce(lambda a, b: a.crossJoin(b), parts)  # four rows of one
    return one.select("edges_scanned", (F.col("edges_scanned") - F.col("edges_kept")).alias("edges_removed"), "nodes_scanned", "nodes_removed")


@query("relation_resolve", sql("SELECT r.ordinal, a.name AS source_name FROM relationships r JOIN entities a ON r.source = a.ordinal AND r.source_id = a.source_id JOIN entities b ON r.target = b.ordinal AND r.source_id = b.source_id"))
def relation_resolve(spark, d):
    r, e = m.relationships(spark, d), m.entities(spark, d)
    a = e.select(F.col("ordinal").alias("source"), "source_id", F.col("name").alias("source_name"))
    b = e.select(F.col("ordinal").alias("target"), "source_id")
    return r.join(a, ["source", "source_id"]).join(b, ["target", "source_id"], "left_semi").select("ordinal", "source_name")


def with_inverses(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Edges (src, dst, template_id, properties) and, for types with an inverse, the same turned around under its name.

    ``types`` has (name, inverse, symmetric). A turned edge names its type in the property ``inverse_of``; symmetric types, types that are their own inverse, and self loops
    get none, and one that is there already isn't made again.
    """
    named = types.where("inverse is not null and inverse <> name and not coalesce(symmetric, false)").select(F.col("name").alias("_name"), "inverse").dropDuplicates(["_name"])
    turned = edges.join(named, edges.template_id == F.col("_name")).where("src <> dst").select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("inverse").alias("template_id"), F.map_concat(F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, v: k != "inverse_of"), F.create_map(F.lit("inverse_of"), "_name")).alias("properties")
    )
    fresh = turned.join(edges.select("src", "dst", "template_id"), ["src", "dst", "template_id"], "left_anti").dropDuplicates(["src", "dst", "template_id"])
    return edges.select("src", "dst", "template_id", "properties").unionByName(fresh)


@query("inverse_edges", sql("""WITH t AS (SELECT * FROM (VALUES ('part_of', 'has_part'), ('bought', 'bought_by'), ('located_in', 'supplied_by')) t(name, inverse)),
  i AS (SELECT DISTINCT dst AS src, src AS dst, inverse AS template_id, name FROM edges JOIN t ON name = template_id WHERE src <> dst), f AS (SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = i.src AND e.dst = i.dst AND e.template_id = i.template_id))
  SELECT template_id, inverse_of, count(*) AS n FROM (SELECT template_id, NULL AS inverse_of FROM edges UNION ALL SELECT template_id, name FROM f) GROUP BY ALL"""))
def inverse_edges(spark, d):
    """Some types have inverses; trade is symmetric, and a type that is its own inverse needs none."""
    e = m.edges(spark, d).select("src", "dst", "template_id", F.lit(None).cast("map<string,string>").alias("properties"))
    types = spark.createDataFrame([("part_of", "has_part", False), ("bought", "bought_by", None), ("located_in", "supplied_by", False), ("trades_with", "sells_to", True), ("refers_to", "refers_to", False), ("supplied_by", None, False)], "name string, inverse string, symmetric boolean")
    return with_inverses(e, types).groupBy("template_id", F.col("properties")["inverse_of"].alias("inverse_of")).agg(F.count("*").alias("n"))


def matched_templates(entities: DataFrame, templates: DataFrame, default: str = "Entity") -> DataFrame:
    """Add template and matched: the template of the entity's source whose name is its type but for case and blanks around, else ``default``.

    ``templates`` has (source_id, name); of names that differ in case only the first by name counts.
    """
    key = lambda c: F.lower(F.trim(c))
    named = templates.groupBy(F.col("source_id").alias("_source"), key("name").alias("_key")).agg(F.min("name").alias("_template"))
    found = entities.join(named, (entities.source_id == F.col("_source")) & (key(entities.type) == F.col("_key")), "left")
    return found.withColumns({"matched": F.col("_template").isNotNull(), "template": F.coalesce("_template", F.lit(default))}).drop("_source", "_key", "_template")


@query("template_match", sql("""WITH t AS (SELECT source_id, lower(trim(type, ' ')) AS k, min(name) AS name FROM (SELECT source_id, type, CASE WHEN ordinal % 2 = 0 THEN upper(type) ELSE type END AS name FROM mentions WHERE ordinal % 8 < 4 AND type <> 'Unknown') GROUP BY 1, 2)
  SELECT m.ordinal, coalesce(t.name, 'Entity') AS template, t.name IS NOT NULL AS matched FROM mentions m LEFT JOIN t ON t.source_id = m.source_id AND t.k = lower(trim(m.type, ' '))"""))
def template_match(spark, d):
    """Templates are those of the source's first four entities, some in capitals."""
    e = m.mentions(spark, d)
    templates = e.where("ordinal % 8 < 4 AND type <> 'Unknown'").select("source_id", F.when(F.col("ordinal") % 2 == 0, F.upper("type")).otherwise(F.col("type")).alias("name"))
    return matched_templates(e, templates).select("ordinal", "template", "matched")


# ---- sorts and pages -----------------------------------------------------------------------


@query("page_scan", sql("SELECT source_id, filename, (SELECT count(*) FROM sources WHERE enabled) AS total FROM sources WHERE enabled ORDER BY created_day DESC LIMIT 5 OFFSET 5"))
def page_scan(spark, d):
    s = m.sources(spark, d).where("enabled").select("source_id", "filename", "created_day")
    return page(s, [F.desc("created_day"), F.col("source_id")], 5, 5).drop("created_day")


@query("iter_embeddings", "SELECT vec_id, len(embedding) AS size FROM embeddings WHERE vec_id > 100 ORDER BY vec_id LIMIT 50")
def iter_embeddings(spark, d):
    """A page after a key."""
    return m.table(spark, d, "embeddings").where("vec_id > 100").orderBy("vec_id").limit(50).select("vec_id", F.size("embedding").cast("bigint").alias("size"))


@query("topk_entities_sorted", sql("SELECT ordinal, name, confidence FROM entities WHERE source_id = 5 ORDER BY confidence DESC, ordinal LIMIT 15 OFFSET 5"))
def topk_entities_sorted(spark, d):
    return m.entities(spark, d).where("source_id = 5").orderBy(F.desc("confidence"), "ordinal").offset(5).limit(15).select("ordinal", "name", "confidence")


@query("topk_cited", sql("SELECT entity_uri, count(*) AS n FROM citations GROUP BY entity_uri ORDER BY n DESC, entity_uri LIMIT 10"))
def topk_cited(spark, d):
    return m.citations(spark, d).groupBy("entity_uri").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_uri").limit(10)


@query("list_by_created", sql("SELECT source_id FROM sources ORDER BY created_day DESC LIMIT 10"))
def list_by_created(spark, d):
    return m.sources(spark, d).orderBy(F.desc("created_day"), "source_id").limit(10).select("source_id")


# ---- sets ----------------------------------------------------------------------------------


@query("union_endpoints", sql("SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id"))
def union_endpoints(spark, d):
    return endpoints(m.edges(spark, d)).groupBy("id").agg(F.count("*").alias("n"))


@query("hybrid_union_max", "SELECT id, max(score) AS score FROM (SELECT vec_id AS id, label / 10.0 AS score FROM embeddings UNION ALL SELECT doc_id, round(n_chars % 97 / 97.0, 6) FROM documents) GROUP BY id")
def hybrid_union_max(spark, d):
    from graphloom.operators.ranking import union_max

    a = m.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") / 10.0).alias("score"))
    b = m.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.round(F.col("n_chars") % 97 / 97.0, 6).alias("score"))
    return union_max(a, b)


@query("distinct_uris_grouped", sql("SELECT source_id, count(DISTINCT entity_uri) AS n, min(entity_uri) AS first_uri FROM citations WHERE source_id IN (1, 2, 3) GROUP BY source_id"))
def distinct_uris_grouped(spark, d):
    c = m.citations(spark, d).where(F.col("source_id").isin(1, 2, 3)).select("source_id", "entity_uri").distinct()
    return c.groupBy("source_id").agg(F.count("*").alias("n"), F.min("entity_uri").alias("first_uri"))


@query("except_orphans", sql("SELECT entity_uri FROM citations WHERE source_id = 1 EXCEPT SELECT entity_uri FROM citations WHERE source_id IN (2, 3, 4)"))
def except_orphans(spark, d):
    c = m.citations(spark, d)
    return c.where("source_id = 1").select("entity_uri").subtract(c.where("source_id in (2, 3, 4)").select("entity_uri"))


def compose(packages: list[tuple[str, DataFrame]], how: str) -> DataFrame:
    """Merge packages' entities (id, label): ``namespace`` prefixes ids, ``first`` or ``last`` wins otherwise."""
    if how == "namespace":
        return reduce(DataFrame.unionByName, [p.select(F.concat(F.lit(f"{name}:"), "id").alias("id"), "label", F.lit(name).alias("package")) for name, p in packages])
    ranked = reduce(DataFrame.unionByName, [p.select("id", "label", F.lit(name).alias("package"), F.lit(k if how == "first" else -k).alias("_rank")) for k, (name, p) in enumerate(packages)])
    return ranked.groupBy("id").agg(F.min(F.struct("_rank", "label", "package")).alias("w")).select("id", "w.label", "w.package")


@query("package_union", sql("SELECT coalesce(b.id, a.id) AS id, coalesce(b.label, a.label) AS label, CASE WHEN b.id IS NULL THEN 'one' ELSE 'two' END AS package FROM (SELECT id, label FROM nodes WHERE template_id IN ('nation', 'region')) a FULL JOIN (SELECT id, upper(label) || '!' AS label FROM nodes WHERE template_id IN ('nation', 'supplier')) b ON a.id = b.id"))
def package_union(spark, d):
    n = m.nodes(spark, d)
    one, two = n.where("template_id in ('nation', 'region')"), n.where("template_id in ('nation', 'supplier')").withColumn("label", F.concat(F.upper("label"), F.lit("!")))
    return compose([("one", one), ("two", two)], "last")


@query("package_union_namespace", sql("SELECT 'one:' || id AS id, label, 'one' AS package FROM nodes WHERE template_id = 'nation' UNION ALL SELECT 'two:' || id, label, 'two' FROM nodes WHERE template_id IN ('nation', 'region')"))
def package_union_namespace(spark, d):
    n = m.nodes(spark, d)
    return compose([("one", n.where("template_id = 'nation'")), ("two", n.where("template_id in ('nation', 'region')"))], "namespace")


def united(entities: DataFrame, by: list[str]) -> DataFrame:
    """(by, aliases, descriptors, source_chunk_indices, merged): arrays of merged entities as sets, sorted; the name itself is no alias. Nulls and empty texts are left out."""
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter("aliases", lambda x: F.trim(x) != "")))))
    sets = entities.groupBy(*by).agg(
        names.alias("aliases"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter("descriptors", lambda x: F.trim(x) != ""))))).alias("descriptors"),
        F.array_sort(F.collect_set("chunk_index")).alias("source_chunk_indices"), F.count("*").alias("merged"),
    )
    return sets.withColumn("aliases", F.filter("aliases", lambda x: x != F.col("name"))) if "name" in by else sets


@query("alias_union", sql("""WITH e AS (SELECT name, brand, type, n_chunks AS chunk_index, CASE WHEN ordinal % 3 = 0 THEN name ELSE lower(brand) END AS other FROM entities)
  SELECT name, (SELECT coalesce(string_agg(DISTINCT x, ',' ORDER BY x), '') FROM (SELECT brand AS x FROM e f WHERE f.name = e.name UNION SELECT other FROM e f WHERE f.name = e.name) WHERE x <> e.name) AS aliases,
  (SELECT coalesce(string_agg(DISTINCT type, ',' ORDER BY type), '') FROM e f WHERE f.name = e.name) AS descriptors, string_agg(DISTINCT chunk_index, ',' ORDER BY chunk_index) AS chunks, count(*) AS merged FROM e GROUP BY name"""))
def alias_union(spark, d):
    """Aliases, descriptors and chunks of entities with one name."""
    other = F.when(F.col("ordinal") % 3 == 0, F.col("name")).otherwise(F.lower("brand"))
    e = m.entities(spark, d).select("name", F.array("brand", other, F.lit(" ")).alias("aliases"), F.array("type").alias("descriptors"), F.col("n_chunks").alias("chunk_index"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return united(e, ["name"]).select("name", text("aliases").alias("aliases"), text("descriptors").alias("descriptors"), text("source_chunk_indices").alias("chunks"), "merged")
