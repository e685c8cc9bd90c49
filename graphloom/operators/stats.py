"""Aggregations over the graph, its citations, model calls and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom import model as m
from graphloom.catalog import query
from graphloom.operators.relational import SYSTEM_TEMPLATES, endpoints, sql

# Model prices per million tokens (input, output), made-up models.
PRICES = [("large", 3.0, 15.0), ("small", 0.25, 1.25)]
SPEED_BEST_MS, SPEED_WORST_MS = 500, 30_000


def one_row(*parts: DataFrame) -> DataFrame:
    """Side by side what are aggregates of one row each."""
    return reduce(lambda a, b: a.crossJoin(b), parts)


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, 0 without a whole."""
    return F.when(whole == 0, 0.0).otherwise(F.round(part / whole, digits))


@query("counts_summary", sql("""SELECT (SELECT count(*) FROM nodes WHERE template_id <> 'region') AS knowledge_nodes, (SELECT count(*) FROM edges) AS edges,
  (SELECT count(DISTINCT template_id) FROM nodes) AS templates, (SELECT count(*) FROM sources) AS sources"""))
def counts_summary(spark, d):
    n, e, s = m.nodes(spark, d), m.edges(spark, d), m.sources(spark, d)
    return one_row(
        n.agg(F.count_if(~F.col("template_id").isin(*SYSTEM_TEMPLATES)).alias("knowledge_nodes"), F.count_distinct("template_id").alias("templates")),
        e.agg(F.count("*").alias("edges")), s.agg(F.count("*").alias("sources")),
    )


@query("count_nodes", sql("SELECT template_id, source_id, count(*) AS n FROM nodes WHERE template_id <> 'part' GROUP BY template_id, source_id"))
def count_nodes(spark, d):
    return m.nodes(spark, d).where("template_id <> 'part'").groupBy("template_id", "source_id").agg(F.count("*").alias("n"))


@query("edges_per_node", sql("SELECT n.id, count(e.id) AS degree FROM nodes n LEFT JOIN (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) e ON n.id = e.id GROUP BY n.id"))
def edges_per_node(spark, d):
    degrees = endpoints(m.edges(spark, d)).groupBy("id").agg(F.count("*").alias("degree"))
    return m.nodes(spark, d).select("id").join(degrees, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("bigint")).alias("degree"))


@query("template_usage", sql("""SELECT coalesce(a.template_id, b.template_id) AS template_id, coalesce(a.n, 0) AS node_count, coalesce(b.n, 0) AS edge_count FROM (SELECT template_id, count(*) AS n FROM nodes GROUP BY 1) a
  FULL JOIN (SELECT template_id, count(*) AS n FROM edges GROUP BY 1) b ON a.template_id = b.template_id"""))
def template_usage(spark, d):
    zero = F.lit(0).cast("bigint")
    both = m.nodes(spark, d).select("template_id", F.lit(1).alias("node"), F.lit(0).alias("edge")).unionByName(m.edges(spark, d).select("template_id", F.lit(0).alias("node"), F.lit(1).alias("edge")))
    return both.groupBy("template_id").agg(F.coalesce(F.sum("node"), zero).alias("node_count"), F.coalesce(F.sum("edge"), zero).alias("edge_count"))


@query("nodes_per_source", sql("SELECT source_id, count(*) AS n FROM nodes WHERE source_id IS NOT NULL GROUP BY source_id"))
def nodes_per_source(spark, d):
    return m.nodes(spark, d).where("source_id is not null").groupBy("source_id").agg(F.count("*").alias("n"))


@query("template_per_source", sql("SELECT source_id, count(*) FILTER (WHERE template_id = 'customer') AS customer, count(*) FILTER (WHERE template_id = 'supplier') AS supplier, count(*) FILTER (WHERE template_id = 'nation') AS nation FROM nodes WHERE source_id IS NOT NULL GROUP BY source_id"))
def template_per_source(spark, d):
    pivoted = m.nodes(spark, d).where("source_id is not null").groupBy("source_id").pivot("template_id", ["customer", "supplier", "nation"]).agg(F.count(F.lit(1)))
    return pivoted.na.fill(0)


def graph_breakdown(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source: name, type, entities, links inside it, templates by falling count and then name."""
    counts = nodes.where("source_id is not null").groupBy("source_id", "template_id").agg(F.count("*").alias("n"))
    per = counts.groupBy("source_id").agg(F.sum("n").alias("entities"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "template_id"))).alias("t"))
    ends = nodes.where("source_id is not null").select("id", "source_id")
    a, b = ends.select(F.col("id").alias("src"), F.col("source_id").alias("s1")), ends.select(F.col("id").alias("dst"), F.col("source_id").alias("s2"))
    links = edges.select("src", "dst").join(a, "src").join(b, "dst").where("s1 = s2").groupBy(F.col("s1").alias("source_id")).agg(F.count("*").alias("links"))
    return sources.join(per, "source_id", "left").join(links, "source_id", "left").select(
        "source_id", F.coalesce("title", "filename").alias("name"), F.coalesce("source_type", F.lit("unknown")).alias("type"),
        F.coalesce("entities", F.lit(0).cast("bigint")).alias("entities"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"),
        F.array_join(F.transform("t", lambda x: F.concat(x["template_id"], F.lit("="), -x["minus"])), ",").alias("templates"),
    )


@query("graph_breakdown", sql("""SELECT s.source_id, coalesce(s.title, s.filename) AS name, coalesce(s.source_type, 'unknown') AS type, coalesce(e.n, 0) AS entities, coalesce(l.n, 0) AS links, e.templates FROM sources s
  LEFT JOIN (SELECT source_id, CAST(sum(n) AS BIGINT) AS n, string_agg(template_id || '=' || n, ',' ORDER BY n DESC, template_id) AS templates FROM (SELECT source_id, template_id, count(*) AS n FROM nodes GROUP BY 1, 2) GROUP BY 1) e ON s.source_id = e.source_id
  LEFT JOIN (SELECT a.source_id, count(*) AS n FROM edges x JOIN nodes a ON x.src = a.id JOIN nodes b ON x.dst = b.id WHERE a.source_id = b.source_id GROUP BY 1) l ON s.source_id = l.source_id"""))
def graph_breakdown_query(spark, d):
    return graph_breakdown(m.nodes(spark, d), m.edges(spark, d), m.sources(spark, d))


def node_stats(nodes: DataFrame, edges: DataFrame, citations: DataFrame) -> DataFrame:
    """Per node: incoming, outgoing and all edges, different edge templates at it, citations."""
    ends = edges.select("template_id", F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("out")))).alias("e"))
    # templates are few, so counts by (node, template) come first and combine before the shuffle
    by = ends.groupBy("e.id", "template_id").agg(F.count("*").alias("n"), F.sum("e.out").alias("out"))
    per = by.groupBy("id").agg(F.sum("n").alias("total"), F.sum("out").alias("outgoing"), F.count("*").alias("edge_types"))
    cited = citations.groupBy(F.col("entity_uri").alias("id")).agg(F.count("*").alias("citations"))
    zero = F.lit(0).cast("bigint")
    total, outgoing = F.coalesce("total", zero), F.coalesce("outgoing", zero)
    return nodes.select("id", "label").join(per, "id", "left").join(cited, "id", "left").select(
        "id", "label", (total - outgoing).alias("incoming"), outgoing.alias("outgoing"), total.alias("total"),
        F.coalesce("edge_types", zero).alias("edge_types"), F.coalesce("citations", zero).alias("citations"),
    )


@query("node_stats_batch", sql("""SELECT n.id, n.label, coalesce(e.i, 0) AS incoming, coalesce(e.o, 0) AS outgoing, coalesce(e.i + e.o, 0) AS total, coalesce(e.t, 0) AS edge_types, coalesce(c.n, 0) AS citations FROM nodes n
  LEFT JOIN (SELECT id, count(*) FILTER (WHERE NOT is_out) AS i, count(*) FILTER (WHERE is_out) AS o, count(DISTINCT template_id) AS t FROM (SELECT src AS id, true AS is_out, template_id FROM edges UNION ALL SELECT dst, false, template_id FROM edges) GROUP BY id) e ON n.id = e.id
  LEFT JOIN (SELECT entity_uri, count(*) AS n FROM citations GROUP BY 1) c ON n.id = c.entity_uri"""))
def node_stats_batch(spark, d):
    return node_stats(m.nodes(spark, d), m.edges(spark, d), m.citations(spark, d))


def connected_nodes(edges: DataFrame, nodes: DataFrame, start: str) -> DataFrame:
    """Neighbours of a node with the first relationship and direction, and their own degree."""
    at = edges.where((F.col("src") == start) | (F.col("dst") == start))
    out = F.col("src") == start
    near = at.groupBy(F.when(out, F.col("dst")).otherwise(F.col("src")).alias("id")).agg(F.min(F.struct("template_id", F.when(out, "out").otherwise("in").alias("direction"))).alias("first"))
    around = endpoints(edges).join(near.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("edge_count"))
    return near.join(nodes.select("id", "label"), "id").join(around, "id").select("id", "label", F.col("first.template_id").alias("relationship"), F.col("first.direction").alias("direction"), "edge_count")


@query("connected_nodes", sql("""WITH near AS (SELECT id, min(template_id) AS relationship, arg_min(direction, template_id || direction) AS direction FROM (SELECT dst AS id, template_id, 'out' AS direction FROM edges WHERE src = 'n:6' UNION ALL SELECT src, template_id, 'in' FROM edges WHERE dst = 'n:6') GROUP BY id)
  SELECT n.id, n.label, near.relationship, near.direction, d.c AS edge_count FROM near JOIN nodes n ON n.id = near.id JOIN (SELECT id, count(*) AS c FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id) d ON d.id = near.id ORDER BY d.c DESC, n.id LIMIT 20"""))
def connected_nodes_query(spark, d):
    return connected_nodes(m.edges(spark, d), m.nodes(spark, d), "n:6").orderBy(F.desc("edge_count"), "id").limit(20)


@query("source_stats", sql("SELECT source_id, count(*) AS citations, count(DISTINCT entity_uri) AS entities, round(avg(confidence), 2) AS avg_confidence, count(*) FILTER (WHERE coalesce(entity_type, 'Unknown') = 'Unknown') AS unknown_type, count(*) FILTER (WHERE entity_type = 'O') AS type_o FROM citations GROUP BY source_id"))
def source_stats(spark, d):
    t = F.coalesce("entity_type", F.lit("Unknown"))
    return m.citations(spark, d).groupBy("source_id").agg(
        F.count("*").alias("citations"), F.count_distinct("entity_uri").alias("entities"), F.round(F.avg("confidence"), 2).alias("avg_confidence"),
        F.count_if(t == "Unknown").alias("unknown_type"), F.count_if(t == "O").alias("type_o"),
    )


@query("source_type_distribution", sql("SELECT source_id, coalesce(entity_type, 'Unknown') AS type, count(*) AS n FROM citations GROUP BY 1, 2"))
def source_type_distribution(spark, d):
    return m.citations(spark, d).groupBy("source_id", F.coalesce("entity_type", F.lit("Unknown")).alias("type")).agg(F.count("*").alias("n"))


@query("extraction_task_stats", sql("""SELECT source_id, count(*) AS tasks, CAST(sum(input_tokens) AS BIGINT) AS input_sum, min(input_tokens) AS input_min, max(input_tokens) AS input_max, round(avg(input_tokens + output_tokens), 2) AS total_avg, max(duration_ms) AS duration_max,
  round(100.0 * avg(input_tokens + output_tokens) / 8192, 2) AS utilization FROM (SELECT *, max(user_id) OVER (PARTITION BY source_id) AS latest FROM metrics) WHERE user_id = latest AND success GROUP BY source_id"""))
def extraction_task_stats(spark, d):
    """Completed tasks of each source's latest job (the largest user_id)."""
    x = m.metrics(spark, d)
    latest = x.groupBy("source_id").agg(F.max("user_id").alias("user_id"))
    total = F.col("input_tokens") + F.col("output_tokens")
    return x.where("success").join(latest, ["source_id", "user_id"], "left_semi").groupBy("source_id").agg(
        F.count("*").alias("tasks"), F.sum("input_tokens").alias("input_sum"), F.min("input_tokens").alias("input_min"), F.max("input_tokens").alias("input_max"),
        F.round(F.avg(total), 2).alias("total_avg"), F.max("duration_ms").alias("duration_max"), F.round(100.0 * F.avg(total) / 8192, 2).alias("utilization"),
    )


@query("chunk_task_summary", "SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'view') AS pending, count(*) FILTER (WHERE event_type = 'click') AS running, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'purchase') AS completed FROM events GROUP BY user_id")
def chunk_task_summary(spark, d):
    count = lambda kind, name: F.count_if(F.col("event_type") == kind).alias(name)
    return m.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total"), count("view", "pending"), count("click", "running"), count("error", "failed"), count("purchase", "completed"))


def llm_metrics(x: DataFrame, spread: float = 2.0) -> DataFrame:
    """One row: calls, retries, waste, rates and the calls that took far longer than the mean (three calls at least)."""
    timed = F.when(F.col("duration_ms") > 0, F.col("duration_ms"))
    base = x.agg(
        F.count("*").alias("calls"), F.count_if("success").alias("successes"), F.count_if(F.col("success") & ~F.col("was_retry")).alias("first_try"),
        F.count_if(F.col("success") & F.col("was_retry")).alias("retry_successes"), F.count_if(~F.col("success")).alias("failed"),
        F.sum(F.when(~F.col("success"), F.col("input_tokens") + F.col("output_tokens")).otherwise(0)).alias("waste_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
        F.floor(F.avg(timed)).alias("avg_duration"), (F.avg(timed) + spread * F.stddev_samp(timed)).alias("_limit"), F.count(timed).alias("_timed"),
    )
    slow = x.crossJoin(F.broadcast(base.select("_limit", "_timed"))).agg(F.count_if((F.col("_timed") >= 3) & (F.col("duration_ms") > F.col("_limit"))).alias("outliers"))
    return one_row(base, slow).select(
        "calls", "successes", "first_try", "retry_successes", F.greatest(F.lit(0), F.col("failed") - F.col("retry_successes")).alias("permanent"), "waste_tokens", "avg_duration", "outliers",
        share(F.col("successes"), F.col("calls")).alias("success_rate"), share(F.col("waste_tokens"), F.col("tokens")).alias("waste_rate"),
    )


@query("llm_metrics_summary", sql("""WITH s AS (SELECT count(*) AS calls, count(*) FILTER (WHERE success) AS successes, count(*) FILTER (WHERE success AND NOT was_retry) AS first_try, count(*) FILTER (WHERE success AND was_retry) AS retry_successes, count(*) FILTER (WHERE NOT success) AS failed,
    CAST(sum(CASE WHEN NOT success THEN input_tokens + output_tokens ELSE 0 END) AS BIGINT) AS waste_tokens, sum(input_tokens + output_tokens) AS tokens, CAST(floor(avg(duration_ms) FILTER (WHERE duration_ms > 0)) AS BIGINT) AS avg_duration,
    avg(duration_ms) FILTER (WHERE duration_ms > 0) + 2 * stddev_samp(duration_ms) FILTER (WHERE duration_ms > 0) AS lim FROM metrics)
  SELECT calls, successes, first_try, retry_successes, greatest(0, failed - retry_successes) AS permanent, waste_tokens, avg_duration, (SELECT count(*) FROM metrics WHERE duration_ms > s.lim) AS outliers,
    round(successes / calls, 4) AS success_rate, round(waste_tokens / tokens, 4) AS waste_rate FROM s"""))
def llm_metrics_summary(spark, d):
    return llm_metrics(m.metrics(spark, d))


@query("llm_error_breakdown", sql("SELECT error_type, count(*) AS n FROM metrics WHERE NOT success GROUP BY error_type"))
def llm_error_breakdown(spark, d):
    return m.metrics(spark, d).where("not success").groupBy("error_type").agg(F.count("*").alias("n"))


@query("llm_source_summary", sql("SELECT source_id, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, arg_min(model, rank) AS model FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY c DESC, model) AS rank FROM (SELECT *, count(*) OVER (PARTITION BY source_id, model) AS c FROM metrics)) GROUP BY source_id"))
def llm_source_summary(spark, d):
    """With each source's most used model, the first by name among equals."""
    by = m.metrics(spark, d).groupBy("source_id", "model").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("tokens"))
    return by.groupBy("source_id").agg(F.sum("n").alias("calls"), F.sum("tokens").alias("input_tokens"), F.min(F.struct((-F.col("n")).alias("minus"), "model")).alias("top")).select("source_id", "calls", "input_tokens", "top.model")


def priced(x: DataFrame, prices: list[tuple[str, float, float]]) -> DataFrame:
    """Add cost: by a model's own price, else that of the longest name it starts with, else 0."""
    table = x.sparkSession.createDataFrame(prices, "name string, in_price double, out_price double")
    models = x.select("model").distinct()
    best = models.join(F.broadcast(table), F.col("model").startswith(F.col("name"))).groupBy("model").agg(F.max_by(F.struct("in_price", "out_price"), F.length("name")).alias("p"))
    cost = (F.col("input_tokens") * F.col("p.in_price") + F.col("output_tokens") * F.col("p.out_price")) / 1e6
    return x.join(F.broadcast(best), "model", "left").withColumn("cost", F.coalesce(cost, F.lit(0.0))).drop("p")  # models are few


@query("token_cost", sql("SELECT model, round(sum(input_tokens * i + output_tokens * o) / 1000000, 6) AS cost FROM (SELECT *, CASE WHEN model LIKE 'large%' THEN 3.0 WHEN model LIKE 'small%' THEN 0.25 ELSE 0 END AS i, CASE WHEN model LIKE 'large%' THEN 15.0 WHEN model LIKE 'small%' THEN 1.25 ELSE 0 END AS o FROM metrics) GROUP BY model").replace("round(sum(input_tokens * i + output_tokens * o) / 1000000, 6)", "round(CAST(sum(input_tokens * i + output_tokens * o) AS DOUBLE) / 1000000, 6)"))
def token_cost(spark, d):
    return priced(m.metrics(spark, d), PRICES).groupBy("model").agg(F.round(F.sum("cost"), 6).alias("cost"))


def added_spend(stored: DataFrame, calls: DataFrame) -> DataFrame:
    """(source_id, day, tokens, calls): what was stored with the tokens of new ``calls`` (source_id, day, tokens) added, a row per source and day."""
    fresh = calls.groupBy("source_id", "day").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls"))
    return stored.select("source_id", "day", "tokens", "calls").unionByName(fresh).groupBy("source_id", "day").agg(F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls"))


def spend_checks(spend: DataFrame, source_cap: int, day_cap: int) -> DataFrame:
    """Add source_tokens, day_tokens and blocked: source, day or null, the cap that is reached; the source's, over all its days, first."""
    of_source, of_day = spend.groupBy("source_id").agg(F.sum("tokens").alias("source_tokens")), spend.groupBy("day").agg(F.sum("tokens").alias("day_tokens"))
    blocked = F.when(F.col("source_tokens") >= source_cap, "source").when(F.col("day_tokens") >= day_cap, "day")
    return spend.join(of_source, "source_id").join(of_day, "day").withColumn("blocked", blocked)


@query("daily_spend", sql("""WITH c AS (SELECT source_id, day, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, count(*) AS calls FROM metrics GROUP BY ALL), s AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY source_id) AS BIGINT) AS source_tokens, CAST(sum(tokens) OVER (PARTITION BY day) AS BIGINT) AS day_tokens FROM c)
  SELECT *, CASE WHEN source_tokens >= 480000 THEN 'source' WHEN day_tokens >= 400000 THEN 'day' END AS blocked FROM s"""))
def daily_spend(spark, d):
    """Spend per source and day, added up from two halves of the calls, and the caps that it reaches."""
    calls = m.metrics(spark, d).select("id", "source_id", "day", (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    none = calls.limit(0).select("source_id", "day", "tokens", F.lit(0).cast("bigint").alias("calls"))
    stored = added_spend(none, calls.where("id % 2 = 0"))
    return spend_checks(added_spend(stored, calls.where("id % 2 = 1")), 480000, 400000)


@query("workflow_stats", sql("SELECT user_id, count(*) AS total, count(*) FILTER (WHERE success) AS completed, round(100.0 * count(*) FILTER (WHERE success) / count(*), 2) AS success_rate, round(avg(duration_ms) FILTER (WHERE success), 2) AS avg_duration, min(duration_ms) FILTER (WHERE success) AS min_duration, max(duration_ms) FILTER (WHERE success) AS max_duration FROM metrics GROUP BY user_id"))
def workflow_stats(spark, d):
    done = F.when(F.col("success"), F.col("duration_ms"))
    return m.metrics(spark, d).groupBy("user_id").agg(
        F.count("*").alias("total"), F.count_if("success").alias("completed"), F.round(100.0 * F.count_if("success") / F.count("*"), 2).alias("success_rate"),
        F.round(F.avg(done), 2).alias("avg_duration"), F.min(done).alias("min_duration"), F.max(done).alias("max_duration"),
    )


@query("trigger_stats", sql("SELECT event_type, count(*) AS runs, (SELECT string_agg(id, ',' ORDER BY id DESC) FROM (SELECT id FROM metrics m2 WHERE m2.event_type = m1.event_type ORDER BY id DESC LIMIT 5)) AS last FROM metrics m1 GROUP BY event_type"))
def trigger_stats(spark, d):
    """Runs of each trigger and its last five; only five rows of a group are ever kept."""
    x = m.metrics(spark, d)
    last = x.withColumn("n", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("id")))).where("n <= 5")
    joined = last.groupBy("event_type").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id"), asc=False), lambda v: v.cast("string")), ",").alias("last"))
    return x.groupBy("event_type").agg(F.count("*").alias("runs")).join(joined, "event_type")


def knowledge_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean degree over all nodes, highest degree, density, isolated nodes."""
    degrees = endpoints(edges).groupBy("id").agg(F.count("*").alias("k"))
    d = degrees.join(nodes.select("id"), "id", "left_semi").agg(F.max("k").alias("max_degree"), F.count("*").alias("linked"))
    return one_row(nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges")), d).select(
        "nodes", "edges", "max_degree", (F.col("nodes") - F.col("linked")).alias("isolated"),
        F.round(2 * F.col("edges") / F.col("nodes"), 4).alias("avg_degree"), F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 8).alias("density"),
    )


@query("knowledge_stats", sql("""WITH deg AS (SELECT id, count(*) AS k FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) WHERE id IN (SELECT id FROM nodes) GROUP BY id), n AS (SELECT count(*) AS n FROM nodes), e AS (SELECT count(*) AS e FROM edges)
  SELECT n AS nodes, e AS edges, (SELECT max(k) FROM deg) AS max_degree, n - (SELECT count(*) FROM deg) AS isolated, round(2 * e / n, 4) AS avg_degree, round(e / (n * (n - 1)), 8) AS density FROM n, e"""))
def knowledge_stats_query(spark, d):
    return knowledge_stats(m.nodes(spark, d), m.edges(spark, d))


@query("template_stats", "SELECT round(avg(n), 4) AS avg_properties, max(n) AS most, arg_min(p_brand, (-n, p_brand)) AS most_complex FROM (SELECT p_brand, count(DISTINCT p_type) + count(DISTINCT p_size) AS n FROM part GROUP BY p_brand)")
def template_stats(spark, d):
    by = m.table(spark, d, "part").groupBy("p_brand").agg((F.count_distinct("p_type") + F.count_distinct("p_size")).alias("n"))
    return by.agg(F.round(F.avg("n"), 4).alias("avg_properties"), F.max("n").alias("most"), F.min(F.struct((-F.col("n")).alias("minus"), "p_brand")).alias("c")).select("avg_properties", "most", F.col("c.p_brand").alias("most_complex"))


@query("lens_stats", "SELECT count(DISTINCT p_brand) AS input_templates, count(DISTINCT p_type) AS output_templates FROM part")
def lens_stats(spark, d):
    return m.table(spark, d, "part").agg(F.count_distinct("p_brand").alias("input_templates"), F.count_distinct("p_type").alias("output_templates"))


@query("workflow_export_stats", "SELECT count(*) FILTER (WHERE on_) AS enabled, count(*) FILTER (WHERE NOT on_) AS disabled, CAST(sum(steps) AS BIGINT) AS steps, round(avg(steps), 4) AS avg_steps FROM (SELECT conv_id, count(*) AS steps, conv_id % 3 <> 0 AS on_ FROM conversations GROUP BY conv_id)")
def workflow_export_stats(spark, d):
    w = m.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("steps"))
    on = F.col("conv_id") % 3 != 0
    return w.agg(F.count_if(on).alias("enabled"), F.count_if(~on).alias("disabled"), F.sum("steps").alias("steps"), F.round(F.avg("steps"), 4).alias("avg_steps"))


@query("chunk_quality_stats", sql("SELECT count(*) AS chunks, count(*) FILTER (WHERE length(content) = 0) AS empty, CAST(floor(avg(length(content))) AS BIGINT) AS mean_length, CAST(min(length(content)) AS INTEGER) AS shortest, CAST(max(length(content)) AS INTEGER) AS longest, round(stddev_samp(length(content)), 2) AS deviation FROM chunks"))
def chunk_quality_stats(spark, d):
    n = F.length("content")
    return m.chunks(spark, d).agg(F.count("*").alias("chunks"), F.count_if(n == 0).alias("empty"), F.floor(F.avg(n)).alias("mean_length"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.stddev_samp(n), 2).alias("deviation"))


@query("embedding_coverage", "SELECT count(*) AS vectors, round(100.0 * count(*) FILTER (WHERE vec_id % 9 <> 0) / count(*), 2) AS coverage, string_agg(DISTINCT CAST(label AS VARCHAR), ',' ORDER BY CAST(label AS VARCHAR)) AS models, count(*) FILTER (WHERE vec_id % 9 <> 0) = count(*) AS rag_ready FROM embeddings")
def embedding_coverage(spark, d):
    e = m.table(spark, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 9 != 0, F.col("embedding")))
    have = F.count("embedding")
    return e.agg(F.count("*").alias("vectors"), F.round(100.0 * have / F.count("*"), 2).alias("coverage"), F.array_join(F.array_sort(F.collect_set(F.col("label").cast("string"))), ",").alias("models"), (have == F.count("*")).alias("rag_ready"))


@query("citation_stats", sql("SELECT count(*) AS citations, round(count(*) / count(DISTINCT source_id), 2) AS per_source, round(avg(confidence), 3) AS mean_confidence, count(DISTINCT entity_uri) AS entities FROM citations"))
def citation_stats(spark, d):
    return m.citations(spark, d).agg(F.count("*").alias("citations"), F.round(F.count("*") / F.count_distinct("source_id"), 2).alias("per_source"), F.round(F.avg("confidence"), 3).alias("mean_confidence"), F.count_distinct("entity_uri").alias("entities"))


@query("citation_methods", sql("SELECT extraction_method, count(*) AS n FROM citations GROUP BY extraction_method"))
def citation_methods(spark, d):
    return m.citations(spark, d).groupBy("extraction_method").agg(F.count("*").alias("n"))


_GRADE = "CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'fair' WHEN score >= 30 THEN 'poor' ELSE 'failing' END"


def grade_label(score: Column) -> Column:
    """Words for a score of 0 to 100."""
    return F.when(score >= 85, "excellent").when(score >= 70, "good").when(score >= 50, "fair").when(score >= 30, "poor").otherwise("failing")


@query("quality_grade_label", f"SELECT doc_id, {_GRADE} AS grade FROM (SELECT doc_id, n_chars % 101 AS score FROM documents)")
def quality_grade_label(spark, d):
    return m.table(spark, d, "documents").select("doc_id", grade_label(F.col("n_chars") % 101).alias("grade"))


@query("llm_global_stats", sql("SELECT provider, model, count(*) AS calls, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens FROM metrics GROUP BY provider, model"))
def llm_global_stats(spark, d):
    return m.metrics(spark, d).groupBy("provider", "model").agg(F.count("*").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))


@query("quality_counters", sql("SELECT source_id, count(*) FILTER (WHERE error_type = 'parse') AS parse_failures, count(*) FILTER (WHERE error_type = 'timeout') AS timeouts, count(*) FILTER (WHERE was_retry) AS retries FROM metrics GROUP BY source_id"))
def quality_counters(spark, d):
    return m.metrics(spark, d).groupBy("source_id").agg(F.count_if(F.col("error_type") == "parse").alias("parse_failures"), F.count_if(F.col("error_type") == "timeout").alias("timeouts"), F.count_if("was_retry").alias("retries"))


@query("latest_per_group", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_per_group(spark, d):
    return m.table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("event_id", "event_type")).alias("x")).select("user_id", "x.event_id", "x.event_type")


def retrieval_metrics(ranked: DataFrame) -> DataFrame:
    """By band and over all (null band): MRR and recall at 1 and 3 of rows (band, rank), rank null if not found."""
    r = F.col("rank")
    return ranked.groupingSets([["band"], []], "band").agg(
        F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.when(r <= 1, 1.0).otherwise(0.0)), 6).alias("recall_1"), F.round(F.avg(F.when(r <= 3, 1.0).otherwise(0.0)), 6).alias("recall_3"),
    )


@query("retrieval_metrics", """WITH r AS (SELECT 'band' || label AS band, CASE WHEN vec_id % 7 <> 0 THEN vec_id % 7 END AS rank FROM embeddings)
  SELECT band, count(*) AS queries, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_3 FROM r GROUP BY GROUPING SETS ((band), ())""")
def retrieval_metrics_query(spark, d):
    e = m.table(spark, d, "embeddings")
    rank = F.when(F.col("vec_id") % 7 != 0, F.col("vec_id") % 7)
    return retrieval_metrics(e.select(F.concat(F.lit("band"), "label").alias("band"), rank.alias("rank")))


def weighted(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of those values that aren't null, null without any."""
    total = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), w).otherwise(0.0) for v, w in parts])
    return F.when(total > 0, reduce(lambda a, b: a + b, [F.coalesce(v * w, F.lit(0.0)) for v, w in parts]) / total)


@query("chat_judge_metrics", """SELECT role, count(*) AS answers, round(avg(score), 6) AS score FROM (SELECT role, CASE WHEN a IS NULL AND b IS NULL THEN c ELSE (coalesce(a * 0.4, 0) + coalesce(b * 0.4, 0) + c * 0.2) / (CASE WHEN a IS NULL THEN 0 ELSE 0.4 END + CASE WHEN b IS NULL THEN 0 ELSE 0.4 END + 0.2) END AS score FROM
  (SELECT role, CASE WHEN turn % 3 <> 0 THEN CAST(length(text) % 10 AS DOUBLE) END AS a, CASE WHEN turn % 2 <> 0 THEN CAST(conv_id % 10 AS DOUBLE) END AS b, CAST(turn % 5 AS DOUBLE) AS c FROM conversations)) GROUP BY role""")
def chat_judge_metrics(spark, d):
    x = m.table(spark, d, "conversations")
    a = F.when(F.col("turn") % 3 != 0, (F.length("text") % 10).cast("double"))
    b = F.when(F.col("turn") % 2 != 0, (F.col("conv_id") % 10).cast("double"))
    score = weighted([(a, 0.4), (b, 0.4), ((F.col("turn") % 5).cast("double"), 0.2)])
    return x.groupBy("role").agg(F.count("*").alias("answers"), F.round(F.avg(score), 6).alias("score"))


@query("composite_leaderboard", sql("""SELECT model, round(quality, 4) AS quality, round(speed, 4) AS speed, round(cost, 4) AS cost_score, round(0.6 * quality + 0.25 * speed + 0.15 * cost, 4) AS overall FROM
  (SELECT model, 100.0 * avg(CASE WHEN success THEN 1 ELSE 0 END) AS quality, 100 * greatest(0, least(1, (30000 - avg(duration_ms)) / 29500)) AS speed,
    100 * greatest(0, least(1, 1 - avg(input_tokens * CASE WHEN model LIKE 'large%' THEN 3.0 WHEN model LIKE 'small%' THEN 0.25 ELSE 0 END + output_tokens * CASE WHEN model LIKE 'large%' THEN 15.0 WHEN model LIKE 'small%' THEN 1.25 ELSE 0 END) / 1000000.0)) AS cost FROM metrics GROUP BY model)"""))
def composite_leaderboard(spark, d):
    by = priced(m.metrics(spark, d), PRICES).groupBy("model").agg((100.0 * F.avg(F.col("success").cast("double"))).alias("quality"), F.avg("duration_ms").alias("ms"), F.avg("cost").alias("usd"))
    clamp = lambda c: 100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    scored = by.select("model", "quality", clamp((SPEED_WORST_MS - F.col("ms")) / (SPEED_WORST_MS - SPEED_BEST_MS)).alias("speed"), clamp(1 - F.col("usd")).alias("cost_score"))
    overall = weighted([(F.col("quality"), 0.6), (F.col("speed"), 0.25), (F.col("cost_score"), 0.15)])
    return scored.select("model", F.round("quality", 4).alias("quality"), F.round("speed", 4).alias("speed"), F.round("cost_score", 4).alias("cost_score"), F.round(overall, 4).alias("overall"))


@query("queue_stats", "SELECT count(*) FILTER (WHERE event_type = 'view') AS queued, count(*) FILTER (WHERE event_type = 'click') AS running, count(DISTINCT user_id) AS workers FROM events")
def queue_stats(spark, d):
    return m.table(spark, d, "events").agg(F.count_if(F.col("event_type") == "view").alias("queued"), F.count_if(F.col("event_type") == "click").alias("running"), F.count_distinct("user_id").alias("workers"))


@query("token_stats", sql("SELECT provider, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM metrics GROUP BY provider"))
def token_stats(spark, d):
    return m.metrics(spark, d).groupBy("provider").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


@query("dashboard", sql("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM metrics) AS calls, (SELECT count(*) FROM metrics WHERE NOT success) AS errors, (SELECT count(DISTINCT conv_id) FROM conversations) AS chats"))
def dashboard(spark, d):
    return one_row(
        m.nodes(spark, d).agg(F.count("*").alias("nodes")), m.edges(spark, d).agg(F.count("*").alias("edges")),
        m.metrics(spark, d).agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("errors")), m.table(spark, d, "conversations").agg(F.count_distinct("conv_id").alias("chats")),
    )


# ---- quality scores ------------------------------------------------------------------------


def steps(value: Column, points: list[tuple[float, float]], otherwise: float) -> Column:
    """Points of the first threshold that the value reaches."""
    out = F.when(value >= points[0][0], float(points[0][1]))
    for threshold, score in points[1:]:
        out = out.when(value >= threshold, float(score))
    return out.otherwise(float(otherwise))


# Points of a description's length, chunks, properties, aliases, a justification's length.
DESCRIPTION = [(250, 20), (150, 17), (100, 14), (50, 10), (20, 6)]
CHUNKS = [(5, 15), (3, 12), (2, 8)]
PROPERTIES = [(7, 15), (5, 13), (3, 10), (2, 7), (1, 4)]
ALIASES = [(3, 10), (2, 8), (1, 5)]
JUSTIFICATION = [(50, 35), (40, 30), (25, 22), (10, 15)]
TYPE_VALUE, RELATION_TYPE_VALUE = 18.0, 15.0


def entity_score(e: DataFrame, type_value: float = TYPE_VALUE) -> Column:
    """0 to 100 from description_length, confidence, n_chunks, n_properties, n_aliases and type."""
    return F.least(F.lit(100.0), (
        steps(e.description_length, DESCRIPTION, 3) + e.confidence * 15 + steps(e.n_chunks, CHUNKS, 7)
        + steps(e.n_properties, PROPERTIES, 0) + steps(e.n_aliases, ALIASES, 0) + F.when(e.type.isNotNull(), type_value).otherwise(0.0)
    ))


def relationship_score(r: DataFrame, type_value: float = RELATION_TYPE_VALUE) -> Column:
    """0 to 100 from justification_length, confidence, type and references of its ends."""
    refs = F.when(r.n_refs >= 2, 15.0).when(r.n_refs == 1, 8.0).otherwise(0.0)
    return F.least(F.lit(100.0), steps(r.justification_length, JUSTIFICATION, 5) + r.confidence * 25 + type_value + refs)


_ENTITY = """least(100.0, CASE WHEN description_length >= 250 THEN 20 WHEN description_length >= 150 THEN 17 WHEN description_length >= 100 THEN 14 WHEN description_length >= 50 THEN 10 WHEN description_length >= 20 THEN 6 ELSE 3 END + confidence * 15
  + CASE WHEN n_chunks >= 5 THEN 15 WHEN n_chunks >= 3 THEN 12 WHEN n_chunks >= 2 THEN 8 ELSE 7 END + CASE WHEN n_properties >= 7 THEN 15 WHEN n_properties >= 5 THEN 13 WHEN n_properties >= 3 THEN 10 WHEN n_properties = 2 THEN 7 WHEN n_properties = 1 THEN 4 ELSE 0 END
  + CASE n_aliases WHEN 3 THEN 10 WHEN 2 THEN 8 WHEN 1 THEN 5 ELSE 0 END + CASE WHEN type IS NULL THEN 0 ELSE 18 END)"""
_RELATION = """least(100.0, CASE WHEN justification_length >= 50 THEN 35 WHEN justification_length >= 40 THEN 30 WHEN justification_length >= 25 THEN 22 WHEN justification_length >= 10 THEN 15 ELSE 5 END + confidence * 25 + 15 + CASE WHEN n_refs >= 2 THEN 15 WHEN n_refs = 1 THEN 8 ELSE 0 END)"""


@query("quality_entity", sql(f"SELECT ordinal, round({_ENTITY}, 4) AS score FROM entities"))
def quality_entity(spark, d):
    e = m.entities(spark, d)
    return e.select("ordinal", F.round(entity_score(e), 4).alias("score"))


@query("quality_relationship", sql(f"SELECT ordinal, round({_RELATION}, 4) AS score FROM relationships"))
def quality_relationship(spark, d):
    r = m.relationships(spark, d)
    return r.select("ordinal", F.round(relationship_score(r), 4).alias("score"))


def source_quality(entities: DataFrame, relationships: DataFrame, target: float = 2.5) -> DataFrame:
    """Per source: contributions, connectivity, density, pollution, structural penalties, the grade and its label.

    Contribution is the sum of s * s / 100 over scores s; low scores are those below 40. Without relationships
    the entities' share of the grade grows from 0.35 to 0.55.
    """
    es = entities.select("source_id", "ordinal", entity_score(entities).alias("s"))
    rs = relationships.select("source_id", "source", "target", "type", relationship_score(relationships).alias("s"))
    ee = es.groupBy("source_id").agg(F.count("*").alias("n_e"), F.avg("s").alias("avg_e"), F.sum(F.col("s") * F.col("s") / 100).alias("contribution_e"), F.count_if(F.col("s") < 40).alias("low_e"))
    rr = rs.groupBy("source_id").agg(F.count("*").alias("n_r"), F.avg("s").alias("avg_r"), F.count_if(F.col("s") < 40).alias("low_r"))
    degrees = rs.select("source_id", F.explode(F.array("source", "target")).alias("ordinal")).groupBy("source_id", "ordinal").agg(F.count("*").alias("k"))
    linked = degrees.join(es.select("source_id", "ordinal"), ["source_id", "ordinal"], "left_semi").groupBy("source_id").agg(F.count("*").alias("linked"), (F.max("k") / F.percentile("k", F.lit(0.5))).alias("hub"))
    one = rs.select("source_id", "source", "target", "type").distinct()
    other = one.select("source_id", F.col("source").alias("target"), F.col("target").alias("source"), "type").where("source <> target")
    reciprocal = one.join(other.withColumn("back", F.lit(1)), ["source_id", "source", "target", "type"], "left").groupBy("source_id").agg((F.count("back") / F.count("*")).alias("reciprocal"))
    all_ = ee.join(rr, "source_id", "left").join(linked, "source_id", "left").join(reciprocal, "source_id", "left").na.fill(0, ["n_r", "low_r", "linked", "reciprocal", "avg_r"]).na.fill(1.0, ["hub"])
    connectivity = F.col("linked") / F.col("n_e")
    density = F.col("n_r") / F.col("n_e")
    connected = F.least(F.lit(100.0), connectivity * 100 + F.when(connectivity >= 0.9, 10.0).otherwise(0.0))
    dense = F.when(density <= target, density / target * 100).otherwise(F.greatest(F.lit(0.0), 100 - (density - target) * 50))
    pollution = F.least(F.lit(15.0), (F.col("low_e") + F.col("low_r")) / (F.col("n_e") + F.col("n_r")) * 50)
    structural = F.least(F.lit(15.0), F.when((F.col("hub") > 3) & (F.col("n_e") >= 10), F.least(F.lit(10.0), (F.col("hub") - 3) * 2)).otherwise(0.0) + F.when(F.col("reciprocal") > 0.1, F.least(F.lit(10.0), (F.col("reciprocal") - 0.1) * 50)).otherwise(0.0))
    topology = (connected + dense) / 2
    raw = F.when(F.col("n_r") > 0, 0.5 * F.col("avg_r") + 0.35 * F.col("avg_e") + 0.15 * topology).otherwise(0.55 * F.col("avg_e") + 0.45 * topology)
    grade = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw - pollution - structural))
    return all_.select(
        "source_id", F.col("n_e").alias("entities"), F.col("n_r").alias("relationships"), F.round("contribution_e", 4).alias("contribution"), F.round(topology, 4).alias("topology"),
        F.round(pollution, 4).alias("pollution"), F.round(structural, 4).alias("structural"), F.round(grade, 4).alias("grade"), grade_label(grade).alias("label"),
    )


_QUALITY = f"""es AS (SELECT source_id, ordinal, {_ENTITY} AS s FROM entities), rs AS (SELECT source_id, source, target, type, {_RELATION} AS s FROM relationships),
  ee AS (SELECT source_id, count(*) AS n_e, avg(s) AS avg_e, sum(s * s / 100) AS con, count(*) FILTER (WHERE s < 40) AS low_e FROM es GROUP BY 1), rr AS (SELECT source_id, count(*) AS n_r, avg(s) AS avg_r, count(*) FILTER (WHERE s < 40) AS low_r FROM rs GROUP BY 1),
  deg AS (SELECT source_id, ordinal, count(*) AS k FROM (SELECT source_id, source AS ordinal FROM rs UNION ALL SELECT source_id, target FROM rs) x SEMI JOIN es USING (source_id, ordinal) GROUP BY 1, 2),
  lk AS (SELECT source_id, count(*) AS linked, max(k) / quantile_cont(k, 0.5) AS hub FROM deg GROUP BY 1), one AS (SELECT DISTINCT source_id, source, target, type FROM rs),
  rc AS (SELECT a.source_id, count(b.type) / count(*) AS rec FROM one a LEFT JOIN one b ON a.source_id = b.source_id AND a.source = b.target AND a.target = b.source AND a.type = b.type AND a.source <> a.target GROUP BY 1),
  j AS (SELECT *, linked / n_e AS con_r, n_r / n_e AS den FROM ee JOIN rr USING (source_id) JOIN lk USING (source_id) JOIN rc USING (source_id)),
  g AS (SELECT *, (least(100.0, con_r * 100 + CASE WHEN con_r >= 0.9 THEN 10 ELSE 0 END) + CASE WHEN den <= 2.5 THEN den / 2.5 * 100 ELSE greatest(0.0, 100 - (den - 2.5) * 50) END) / 2 AS topology, least(15.0, (low_e + low_r) / (n_e + n_r) * 50) AS pollution,
    least(15.0, CASE WHEN hub > 3 AND n_e >= 10 THEN least(10.0, (hub - 3) * 2) ELSE 0 END + CASE WHEN rec > 0.1 THEN least(10.0, (rec - 0.1) * 50) ELSE 0 END) AS structural FROM j),
  quality AS (SELECT source_id, n_e AS entities, n_r AS relationships, round(con, 4) AS contribution, round(topology, 4) AS topology, round(pollution, 4) AS pollution, round(structural, 4) AS structural, greatest(0.0, least(100.0, 0.5 * avg_r + 0.35 * avg_e + 0.15 * topology - pollution - structural)) AS score FROM g)"""
_QUALITY_OUT = f"SELECT source_id, entities, relationships, contribution, topology, pollution, structural, round(score, 4) AS grade, {_GRADE} AS label FROM quality"


@query("quality_source", sql(f"WITH {_QUALITY} {_QUALITY_OUT}"))
def quality_source(spark, d):
    return source_quality(m.entities(spark, d), m.relationships(spark, d))


@query("quality_analyze", sql(f"WITH {_QUALITY} SELECT count(*) AS sources, round(avg(score), 3) AS avg_grade, round(avg(CASE WHEN relationships > 0 THEN topology END), 3) AS avg_topology FROM quality"))
def quality_analyze(spark, d):
    q = source_quality(m.entities(spark, d), m.relationships(spark, d))
    return q.agg(F.count("*").alias("sources"), F.round(F.avg("grade"), 3).alias("avg_grade"), F.round(F.avg(F.when(F.col("relationships") > 0, F.col("topology"))), 3).alias("avg_topology"))


@query("quality_compare_domains", sql(f"WITH {_QUALITY} SELECT source_id % 4 AS domain, count(*) AS sources, round(avg(score), 3) AS avg_grade FROM quality GROUP BY 1"))
def quality_compare_domains(spark, d):
    q = source_quality(m.entities(spark, d), m.relationships(spark, d))
    return q.groupBy((F.col("source_id") % 4).alias("domain")).agg(F.count("*").alias("sources"), F.round(F.avg("grade"), 3).alias("avg_grade")).orderBy(F.desc("avg_grade"), "domain")


@query("quality_summary", sql(f"WITH {_QUALITY} SELECT 'top' AS side, * FROM (SELECT source_id, round(score, 4) AS grade FROM quality ORDER BY grade DESC, source_id LIMIT 3) UNION ALL SELECT 'bottom', * FROM (SELECT source_id, round(score, 4) AS grade FROM quality ORDER BY grade, source_id LIMIT 3)"))
def quality_summary(spark, d):
    q = source_quality(m.entities(spark, d), m.relationships(spark, d)).select("source_id", "grade")
    top = q.orderBy(F.desc("grade"), "source_id").limit(3).select(F.lit("top").alias("side"), "*")
    return top.unionByName(q.orderBy("grade", "source_id").limit(3).select(F.lit("bottom").alias("side"), "*"))


@query("quality_cache", sql("SELECT source_id, 7 AS version, created_day % 2 = 0 AS fresh FROM sources"))
def quality_cache(spark, d):
    """Which cached scores still hold: those of the current version."""
    cached = m.sources(spark, d).withColumn("cached_version", F.when(F.col("created_day") % 2 == 0, 7).otherwise(6))
    return cached.select("source_id", F.lit(7).alias("version"), (F.col("cached_version") == 7).alias("fresh"))


@query("density_stats", sql("SELECT min(n) AS least, max(n) AS most, round(avg(n), 1) AS mean, round(CASE WHEN min(n) = 0 THEN max(n) ELSE max(n) / min(n) END, 4) AS ratio FROM (SELECT c, count(source_id) AS n FROM (SELECT unnest(range(0, 30)) AS c) LEFT JOIN entities ON source_id = c GROUP BY c)"))
def density_stats(spark, d):
    chunks = spark.range(30).select(F.col("id").cast("int").alias("source_id"))
    per = chunks.join(m.entities(spark, d).groupBy("source_id").agg(F.count("*").alias("n")), "source_id", "left").select(F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    return per.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 1).alias("mean"), F.round(F.when(F.min("n") == 0, F.max("n").cast("double")).otherwise(F.max("n") / F.min("n")), 4).alias("ratio"))


@query("template_suggest_nodes", sql("SELECT upper(left(type, 1)) || lower(substr(type, 2)) AS name, count(*) AS n FROM entities WHERE type IS NOT NULL AND lower(type) NOT IN ('unknown', 'item', 'thing', 'object', 'entity') GROUP BY 1"))
def template_suggest_nodes(spark, d):
    """Node templates that the entities' types suggest."""
    skipped = ("unknown", "item", "thing", "object", "entity")
    return m.entities(spark, d).where(F.col("type").isNotNull() & ~F.lower("type").isin(*skipped)).groupBy(F.initcap("type").alias("name")).agg(F.count("*").alias("n"))


@query("template_suggest_edges", sql("SELECT replace(lower(type), ' ', '_') AS name, count(*) AS n FROM relationships WHERE lower(type) NOT IN ('link', 'unknown', 'relationship', 'connection', 'related') GROUP BY 1"))
def template_suggest_edges(spark, d):
    skipped = ("link", "unknown", "relationship", "connection", "related")
    return m.relationships(spark, d).where(~F.lower("type").isin(*skipped)).groupBy(F.replace(F.lower("type"), F.lit(" "), F.lit("_")).alias("name")).agg(F.count("*").alias("n"))


@query("count_nodes_by_template", sql("SELECT template_id, count(*) AS n FROM nodes WHERE template_id NOT IN ('region') GROUP BY template_id"))
def count_nodes_by_template(spark, d):
    return m.nodes(spark, d).where(~F.col("template_id").isin(*SYSTEM_TEMPLATES)).groupBy("template_id").agg(F.count("*").alias("n"))


@query("count_edges", sql("SELECT template_id, count(*) AS n, count(DISTINCT src) AS sources FROM edges GROUP BY template_id"))
def count_edges(spark, d):
    return m.edges(spark, d).groupBy("template_id").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"))
