"""Parts that grow with the rows, components by hooks, stems and groups in streams."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from graphloom.functions.stem import stem, stems
from graphloom import model
from graphloom.functions import text
from graphloom.operators import citations, extraction, graph, retrieval
from graphloom.operators.retrieval import context_triples
from graphloom.operators.windows import token_groups
from graphloom.plans import spread as s
from graphloom.plans.fixpoint import connected_components
from graphloom.plans.scratch import scratch_path, shared_dir
from graphloom.sources import exchange, queries


def test_parts_grow_with_rows(spark):
    df = spark.range(100)
    assert s.spread(df, 40 * s.ROWS, "id").rdd.getNumPartitions() == 40
    assert s.spread(df, 80 * s.ROWS, "id").rdd.getNumPartitions() == 80
    assert s.spread(df, 2 * s.ROWS, "id") is df


def test_components_by_hooks(spark):
    random.seed(5)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    plain = {tuple(r) for r in connected_components(df).collect()}
    assert {tuple(r) for r in connected_components(df, direct=0).collect()} == plain and len({c for _, c in plain}) > 5


def test_search_ends_at_the_start(spark):
    chain = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(30)], "src string, dst string")
    both = chain.unionByName(chain.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = graph.depths(both, spark.createDataFrame([("n00",)], "id string"), until="n03")
    assert seen.agg(F.max("depth")).first()[0] == 3


def test_stems_of_arrays(spark):
    rows = [(1, ["things", "relating", "things"]), (2, []), (3, None), (4, ["caf\u00e9s", "running"])]
    got = {r.k: r.s for r in spark.createDataFrame(rows, "k int, w array<string>").select("k", stems("w").alias("s")).collect()}
    assert got == {k: None if w is None else [stem(x) for x in w] for k, w in rows}


def test_context_keeps_only_the_tops_edges(spark):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "id string, label string")
    edges = spark.createDataFrame([("a", "b", "t"), ("a", "b", "t"), ("b", "c", "t"), ("b", "a", "u")], "src string, dst string, template_id string")
    tops = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "id string, score double")
    found = context_triples(edges, nodes, tops)
    assert {tuple(r) for r in found.collect()} == {("A", "t", "B"), ("B", "u", "A")} and found.count() == 2
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()  # edges are cut down before they are made distinct


def test_groups_stream_without_a_frame_per_document(spark):
    rows = [(d, i, 200 + 100 * ((d + i) % 5)) for d in range(40) for i in range(d % 7)]
    want = []
    for d in range(40):
        used, group = 0, -1
        for n in [t for k, _, t in rows if k == d]:
            if group < 0 or used + n > 500:
                group, used = group + 1, 0
                want.append([d, group, 0])
            used += n
            want[-1][2] += 1
    found = token_groups(spark.createDataFrame(rows, "doc_id bigint, chunk_index int, tokens int"), 500)
    assert sorted(map(list, found.collect())) == want
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()


def test_pages_of_lines(spark, tmp_path):
    """Many pages share a file, whatever control characters they hold."""
    pages = spark.createDataFrame([(k, f"<p>page {k}\r\tof\nmany</p>") for k in range(500)], "page_id bigint, html string").coalesce(2)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    before = set(Path(shared_dir(spark).removeprefix("file://")).glob("html-*"))
    got = {r.page_id: r.digest for r in queries.scan_html(spark, str(tmp_path)).collect()}
    (new,) = set(Path(shared_dir(spark).removeprefix("file://")).glob("html-*")) - before
    assert len(list(new.rglob("part-*"))) <= 4
    want = pages.select("page_id", F.md5(text.web_basic(F.concat(F.regexp_replace("html", "\n", " "), F.lit("\n")))).alias("digest"))
    assert got == {r.page_id: r.digest for r in want.collect()}


def test_citations_read_documents_once(spark, data, monkeypatch):
    read = []
    table = model.table
    monkeypatch.setattr(model, "table", lambda spark, d, name: read.append(name) or table(spark, d, name))
    written = citations.citation_family(spark, data)
    assert read == ["documents"]
    assert "documents.parquet" not in " ".join(written.inputFiles())


def test_a_pass_for_all_modes(spark):
    """Modes of evidence share their joins: texts are read once, not once a mode."""
    said = spark.createDataFrame([(1, ["Anna met Vronsky."])], "source_id bigint, sentences array<string>")
    e = spark.createDataFrame([(1, 0, "Anna", []), (1, 1, "Vronsky", [])], "source_id bigint, ordinal bigint, name string, aliases array<string>")
    r = spark.createDataFrame([(1, 0, 0, 1, "knows", "S1")], "source_id bigint, ordinal bigint, source bigint, target bigint, type string, sent_ref string")
    modes = {m: m for m in ("off", "relaxed", "standard", "narrative", "strict")}
    got = extraction.relation_modes(r, e, said, modes)
    assert got.first().asDict() | r.first().asDict() == got.first().asDict() and all(got.first()[m] for m in modes)
    plan = extraction.rel_evidence(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3  # sentences and both ends, of all four modes


def test_linked_documents_parsed_once(spark):
    nodes = spark.createDataFrame([("a", "A", "t")], "id string, label string, template_id string")
    edges = spark.createDataFrame([("a", "b", "knows")], "src string, dst string, template_id string")
    n, e = exchange.from_linked(exchange.to_linked(nodes, edges))
    assert [tuple(x) for x in n.collect()] == [("a", "A", "t")] and [tuple(x) for x in e.collect()] == [("a", "b", "knows")]
    assert "get_json_object" not in e._jdf.queryExecution().optimizedPlan().toString()


def test_postings_are_counted_where_texts_are(spark):
    """Weighted counts of plain Python, over more texts than are counted at a time, and without a shuffle of words."""
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices("abcdefgh", k=rng.randrange(30))), " ".join(rng.choices("abc", k=3)) if k % 3 else None) for k in range(700)]
    path = scratch_path(spark, "index")
    retrieval.build_index(spark.createDataFrame(rows, "doc_id bigint, text string, label string").coalesce(1), {"label": 3.0, "text": 0.5}, path, stemmed=False, buckets=4)
    want = {(k, w): 3.0 * (label or "").split().count(w) + 0.5 * text.split().count(w) for k, text, label in rows for w in {*(label or "").split(), *text.split()}}
    got = spark.read.parquet(f"{path}/postings").collect()
    assert {(r.id, r.term): r.tf for r in got} == want and len(got) == len(want)
    sizes = {k: len(text.split()) + len((label or "").split()) for k, text, label in rows}
    assert all(r.length == sizes[r.id] for r in got)
