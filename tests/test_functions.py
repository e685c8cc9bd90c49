"""Chunking, loading, parsing and workflows on small cases."""

import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom import workflow
from graphloom.engine import Engine
from graphloom.functions import chunking, properties, text
from graphloom.operators import resolution
from graphloom.operators.retrieval import cosine
from graphloom.registry import Registry
from graphloom.sources import exchange, loaders


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n!,é", max_size=400), st.integers(10, 80))
def test_chunks_cover_and_fit(value, size):
    spans = chunking.split_text(value, size, size // 5)
    covered = set()
    for a, b in spans:
        assert b > a and b - a <= chunking.MOST
        covered.update(range(a, b))
    assert covered == set(range(len(value)))


def test_locate():
    doc = "One two  three\nfour. " + "x" * 40
    assert chunking.locate(doc, "two") == (4, "exact")
    assert chunking.locate(doc, "two three four") == (4, "spaces")
    assert chunking.locate(doc, "absent") == (None, "none")


def test_prepare_again_changes_nothing(spark):
    rows = spark.createDataFrame([("﻿a\r\n\n\n\nb\n12\nContents ....... 4\nbroken\nline",)], "t string")
    once = rows.select(chunking.prepare("t").alias("t"))
    assert once.first() == once.select(chunking.prepare("t").alias("t")).first()


def test_sentences(spark):
    got = text.split_sentences(spark.createDataFrame([("Dr. Who came. He left! Then no. 5 rang.",), (None,), ("",)], "text string")).collect()
    assert [[r.text[s.start : s.end] for s in r.sentences] for r in got] == [["Dr. Who came.", "He left!", "Then no. 5 rang."], [], []]


def test_sentences_keep_quotes_and_ranks_whole():
    said = "Gen. Lee left at 5 p.m. Monday. \"Go. Now? Yes.\" She did. He said “Stop. Now.” Then ran."
    assert [said[s["start"] : s["end"]] for s in text.sentence_offsets(said)] == ["Gen. Lee left at 5 p.m. Monday.", "\"Go. Now? Yes.\" She did.", "He said “Stop. Now.” Then ran."]


def test_sentence_refs(spark):
    cases = [("S1", [1]), ("S1-S3", [1, 2, 3]), ("s2; S1,S2", [1, 2]), ("S9", None), ("x", None), ("", None), (None, None), ("S3-S1", None)]
    df = spark.createDataFrame(cases, "r string, want array<int>")
    assert all(r.got == r.want for r in df.select("want", text.sentence_refs("r", F.lit(5)).alias("got")).collect())


def test_record_lines(spark):
    value = "E|Alice|Character|||S1|first\n* R|0|1|knows|0.9|S1|alice \\| bob\nP|0|age\nhello\n\nA|old|new|0.5|S1|why|"
    got = [(r.kind, r.valid) for r in text.parse_lines(spark.createDataFrame([(value,)], "text string")).orderBy("line_no").collect()]
    assert got == [("E", True), ("R", True), ("P", False), (None, False), ("A", True)]


def test_property_errors(spark):
    template = [{"name": "n", "type": "integer", "required": True}, {"name": "m", "type": "email"}, {"name": "d", "type": "date"}]
    rows = [({"n": "1", "m": "a@b.c", "d": "2024-02-03"}, []), ({"m": "x"}, ["n: required", "m: not email"]), ({"n": "1.5", "d": "soon"}, ["n: not integer", "d: not date"])]
    df = spark.createDataFrame(rows, "p map<string,string>, want array<string>")
    assert all(r.want == r.got for r in df.select("want", properties.property_errors("p", template).alias("got")).collect())


def test_truth_of_literals(spark):
    cases = [("True", True), ("0", False), ("0.5", True), ("''", False), ("'a'", True), ("[]", False), ("[1]", True), ("oops(", False), (None, False)]
    df = spark.createDataFrame(cases, "v string, want boolean")
    assert all(r.got == r.want for r in df.select("want", properties.truthy(F.col("v")).alias("got")).collect())


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], 1.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], None), (None, [1.0], None)], "a array<double>, b array<double>, want double")
    assert all(r.got == r.want for r in df.select("want", cosine(F.col("a"), F.col("b")).alias("got")).collect())


def test_loaders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name;age\nAnn;3\nBob;\n")
    (tmp_path / "b.jsonl").write_text('{"a":1}\nbroken\n\n{"a":2}\n')
    (tmp_path / "c.json").write_text('{"a": [1]}')
    (tmp_path / "d.txt").write_bytes("café".encode("cp1252"))
    (tmp_path / "e.html").write_text("<html><script>x</script><p>Hi &amp; bye</p></html>")
    (tmp_path / "bad.docx").write_text("not a zip")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "f.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:p><w:r><w:t>one</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p/></w:document>')
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "g.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row><c><v>1</v></c><c t="inlineStr"><is><t>x</t></is></c></row><row/></sheetData></worksheet>')
    with zipfile.ZipFile(tmp_path / "h.zip", "w") as z:
        z.writestr("x.md", "# t")
        z.writestr("y.bin", "no")
    got = lambda n: [(r.content, r.warnings) for r in loaders.load(spark, f"{tmp_path}/{n}").collect()]
    assert got("a.csv") == [("name: Ann, age: 3", 0), ("name: Bob", 0)]
    assert got("b.jsonl") == [('{"a":1}', 1), ('{"a":2}', 1)]
    assert json.loads(got("c.json")[0][0]) == {"a": [1]}
    assert got("d.txt") == [("café", 0)] and got("e.html") == [("Hi & bye", 0)]
    assert got("f.docx") == [("one two", 0)] and got("bad.docx") == [("", 1)]
    assert got("g.xlsx") == [("Sheet: sheet1\n1 | x", 1)] and got("h.zip") == [("# t", 0)]
    with pytest.raises(ValueError):
        loaders.load(spark, "x.unknown")


def test_linked_data_round_trip(spark):
    nodes = spark.createDataFrame([("a", "A", "t"), ("b", 'B "q"', "t")], "id string, label string, template_id string")
    edges = spark.createDataFrame([("a", "b", "knows")], "src string, dst string, template_id string")
    n, e = exchange.from_linked(exchange.to_linked(nodes, edges))
    assert sorted(n.collect()) == sorted(nodes.collect()) and e.collect() == edges.collect()


def test_workflows():
    assert workflow.order({"c": ["a", "b"], "b": ["a"], "a": []}) == ["a", "b", "c"]
    for bad in ({"a": ["b"], "b": ["a"]}, {"a": ["zz"]}):
        with pytest.raises(ValueError):
            workflow.order(bad)
    data = {"a": {"b": [1, {"c": None}]}}
    assert workflow.interpolate({"x": "{{a.b.0}}", "y": "v={{a.b.1.c}};{{ no }}"}, data) == {"x": 1, "y": "v=;"}


def test_registry_origins():
    r = Registry()
    r.register("x", 1, origin="user")
    r.register("x", 2, origin="builtin")
    r.register("y", 3, priority=5)
    assert r["x"] == 1 and list(r) == [3, 1] and r.names() == ["y", "x"]


def test_engine_end_to_end(spark, tmp_path):
    (tmp_path / "d.txt").write_text("Alice met Bob in Paris. " * 60)
    e = Engine(spark)
    docs = e.clean(e.load(f"{tmp_path}/*.txt"))
    chunks = e.embed_chunks(e.chunk(docs))
    e = Engine(spark, chunks=chunks, nodes=spark.createDataFrame([("n1", "Alice"), ("n2", "Bob")], "id string, label string"), edges=spark.createDataFrame([("n1", "n2", "knows")], "src string, dst string, template_id string"))
    assert chunks.count() > 1
    for mode in ("keyword", "semantic", "hybrid"):
        assert e.search("alice paris", mode).count() > 0
    assert e.search("").count() == 0
    assert e.resolve("ali").first().id == "n1"
    entities, relations = e.extract(spark.createDataFrame([("E|Ann|Person|A; B|0.7|S1|d\nR|0|1|Works With|0.9|S1|j",)], "text string"))
    assert entities.first().aliases == ["A", "B"] and relations.first().type == "works_with"
    assert e.delete(["n1"]).edges.count() == 0
    assert {r.component for r in e.components().collect()} == {"n1"}


def test_preprocessing(spark):
    pages = "﻿PART II:\r\nHead\r\nA first line that\r\ngoes on here.  And on.\f Head\n- 7 -\nmore text, ends with a word\n\nand goes on.\n\n12 Introduction\n\nNew one.\fHead\nOne ...... 1\nTwo ..... 2\nIV. Three\nLast line.\n\n\nHead\nof all"
    rows = spark.createDataFrame([(1, pages), (2, None), (3, ""), (4, "X.\n\n\n\ny\nz")], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in chunking.preprocessed(rows).collect()}
    assert got[1] == "A first line that goes on here. And on.\n\nmore text, ends with a word and goes on.\n\nNew one.\n\nLast line.\n\nof all"
    assert got[2] is None and got[3] == "" and got[4] == "X.\n\ny z"
    raw = {r.doc_id: r.text for r in chunking.preprocessed(rows, noise=False, flow=False).collect()}
    assert raw[1].startswith("PART II:\nHead\nA first") and raw[4] == "X.\n\ny\nz"


def test_quotes_are_shielded(spark):
    said = 'He said "Hello! How are you? Fine." and left. “Why? No.” Then "open. and more.\nNext "end."'
    r = spark.createDataFrame([(said,)], "t string").select(chunking.protect_quotes("t").alias("p"), chunking.restore_quotes(chunking.protect_quotes("t")).alias("r")).first()
    assert r.r == said and len(r.p) == len(said) and '"Hello❗ How are you❓ Fine․" and left. “Why❓ No․” Then "open. and more.' in r.p


def test_lines_of_scans(spark):
    from graphloom.operators.chunked import _SCAN_KEEPS, _SCANNED

    rows = spark.createDataFrame([(k, v) for k, v in enumerate(_SCANNED)] + [(90, ""), (91, "  "), (92, "An ordinary line of text, 12 of 13."), (93, "Rhythm")], "k int, line string")
    got = {r.k: r.keep for r in rows.select("k", text.keeps_line(F.col("line")).alias("keep")).collect()}
    assert [got[k] for k in range(len(_SCANNED))] == list(_SCAN_KEEPS) and all(got[k] for k in (90, 91, 92, 93))
    spelt = {r.k: r.keep for r in rows.select("k", text.keeps_line(F.col("line"), F.col("line") == "cat").alias("keep")).collect()}
    assert spelt[12] and not spelt[17] and spelt[92]
