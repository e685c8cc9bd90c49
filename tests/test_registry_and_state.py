"""Tools of workflows, users' patterns, and stateful streams against plain loops."""

import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom import catalog
from graphloom import model as m
from graphloom.functions import user_patterns
from graphloom.operators import vector_index
from graphloom.plans.scratch import scratch_path
from graphloom.registry import TOOLS, Registry, TimedPatterns, UnsafePattern, safe_pattern, tool_schema
from graphloom.streaming import queries as q


def test_tools(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": [5, 7]}}', [1, 2]), (2, "{}", []), (3, None, None)], "id int, data string, xs array<int>")
    assert TOOLS.names() == sorted(TOOLS.names()) and len(TOOLS) >= 9
    assert [r.b for r in TOOLS["data.extract"](rows, "data", "a.b.1", "b").orderBy("id").collect()] == ["7", None, None]
    assert TOOLS["data.filter"](rows, "id > 1").count() == 2
    assert [r.x for r in TOOLS["logic.conditional"](rows, "size(xs) > 0", "'some'", "'none'", "x").orderBy("id").collect()] == ["some", "none", "none"]
    assert [(r.id, r.x_index, r.x) for r in TOOLS["logic.loop"](rows, "xs", "x").collect()] == [(1, 0, 1), (1, 1, 2)]
    other = spark.createDataFrame([(1, "new", 9), (2, None, 8)], "id int, data string, more int")
    assert [(r.data, r.more) for r in TOOLS["data.merge"](rows, other, ["id"]).orderBy("id").collect()] == [("new", 9), ("{}", 8), (None, None)]
    assert TOOLS["data.aggregate"](rows, [], {"n": "count(*)"}).first().n == 3
    assert [r.id for r in TOOLS["data.sort"](rows, ["-id"], 2).collect()] == [3, 2]
    assert [r.hit for r in TOOLS["text.match"](rows, "data", "a.*b", "hit").orderBy("id").collect()] == [True, False, None]


def test_safe_patterns():
    for bad in ("(a+)+", "(a|b)*", r"(x)\\1".replace("\\\\", "\\"), "(?=a)", "(", "a" * 501, "(a*)*b", "(?<n>a)"):
        with pytest.raises(UnsafePattern):
            safe_pattern(bad)
    for good in ("a+b", "[0-9]{2,4}", "(abc)", "(a|b)", "x.*y"):
        assert safe_pattern(good) == good
    slow = TimedPatterns({"a": "(a|aa)+$", "b": "B"}, seconds=0.05, most=2)
    text = "a" * 60 + "b"
    began = time.monotonic()
    assert [slow.search(text) for _ in range(5)] == [["b"]] * 5 and slow.timeouts == {"a": 2, "b": 0} and time.monotonic() - began < 2


def test_custom_categories(spark):
    specs = [{"regex": "(x", "mode": "count"}, {"regex": "^note:", "mode": "line_ratio", "threshold": 0.5}, {"mode": "count"}, {"regex": "a" * 513}, {"regex": "SPAM", "threshold": 2}, {"regex": "(a|aa)+$"}, {"regex": "x", "mode": "odd"}]
    found, errors = user_patterns.compiled(specs)
    assert [c.name for c in found] == ["custom_1", "custom_4", "custom_5"] and [e["index"] for e in errors] == [0, 2, 3, 6]
    rows = [(1, "Note: a\nnote: b\nrest of it"), (2, "spam and spam"), (3, None), (4, "a" * 60 + "b"), (5, "one spam\n\n" + "long " * 40)]
    table = spark.createDataFrame(rows, "id int, text string").withColumn("timeouts", F.lit("old"))
    got = {r.id: (r.clean, r.custom, r.timeouts, r.excluded) for r in user_patterns.strip_categories(table, found).collect()}
    assert got == {1: ("rest of it", ["custom_1"], 0, True), 2: ("", ["custom_4"], 0, True), 3: ("", [], 0, False), 4: ("a" * 60 + "b", [], 1, False), 5: (rows[4][1], [], 0, False)}


def test_model_tools(spark):
    rows = spark.createDataFrame([(1, 'So: ```json\n{"a": 1}\n```'), (2, "[1, 2]"), (3, 'It is {"b": [2]}.'), (4, "none"), (5, None)], "id int, answer string")
    got = {r.id: r.j for r in TOOLS["ai.extract_json"](rows, "answer", "v").selectExpr("id", "to_json(v) AS j").collect()}
    assert got == {1: '{"a":1}', 2: "[1,2]", 3: '{"b":[2]}', 4: None, 5: None}
    asked = TOOLS["ai.prompt"](rows, "{id}: what is {answer}?", "said", F.upper).orderBy("id").collect()
    assert asked[1].said == "2: WHAT IS [1, 2]?" and asked[4].said == "5: WHAT IS ?"
    vectors = TOOLS["ai.generate_embedding"](rows, "answer", "embedding", lambda c: F.array(F.coalesce(F.length(c), F.lit(1)).cast("double"), F.lit(1.0)))
    path = scratch_path(spark, "tool")
    vector_index.build_vector_index(vectors, path, "id")
    near = TOOLS["ai.vector_search"](vectors, path, "id", "embedding", 1, exact=True)
    assert {(r.query_id, r.id) for r in near.collect()} == {(k, k) for k in range(1, 6)}
    nodes = spark.createDataFrame([("a", "P"), ("b", "P"), ("c", None), ("d", "Q")], "id string, template_id string")
    assert [tuple(r) for r in TOOLS["templates.list"](nodes, nodes, "edge").collect()] == [("P", "edge", 2), ("Q", "edge", 1)]
    schema = tool_schema("data.sort")
    assert schema["input"]["required"] == ["rows", "by"] and schema["input"]["properties"]["limit"] == {"type": "integer", "nullable": True, "default": None} and schema["description"].startswith("Rows in the order")


def test_registry_discovers_and_reloads():
    registry = Registry()
    assert registry.discover("graphloom.no_such_group") == []
    from graphloom import workflow

    registry.register("order", workflow.order)
    before = registry["order"]
    registry.reload("order")
    assert registry["order"] is not before and registry["order"]({"a": []}) == ["a"]


def test_pauses_against_a_loop(spark, data):
    per = defaultdict(list)
    for e in q.probe_events(m.table(spark, data, "events")).collect():
        per[e.system].append(e)
    want = set()
    for system, events in per.items():
        fails, passes, tripped, paused, blocked = [0] * 3, [0] * 3, set(), "", False
        for e in sorted(events, key=lambda v: v.event_id):
            before = paused
            if e.kind == "pause":
                paused = "user"
            elif e.kind == "resume":
                paused, blocked, tripped, fails = "", False, set(), [0] * 3
            elif e.kind == "pass":
                fails[e.probe] = 0
                passes[e.probe] += 1
                if paused == "auto" and not blocked and min((passes[k] for k in tripped), default=3) >= 3:
                    paused, tripped = "", set()
            else:
                fails[e.probe] += 1
                passes[e.probe] = 0
                blocked = blocked or e.kind == "fatal"
                if e.kind == "fatal" or fails[e.probe] >= 3:
                    tripped.add(e.probe)
                    paused = paused or "auto"
            if paused != before:
                want.add((system, e.event_id, before, paused))
    got = {tuple(r) for r in catalog.queries()["health_pause"](spark, data).select("system", "event_id", "before", "after").collect()}
    assert got == want and {a for _, _, _, a in want} == {"auto", "user", ""}


def test_lookback_against_a_loop(spark, data):
    from graphloom.functions.text import simhash

    rows = m.chunks(spark, data).select("doc_id", "chunk_index", simhash(F.split(F.lower("content"), " ")).alias("p")).collect()
    per = defaultdict(list)
    for r in sorted(rows, key=lambda v: v.chunk_index):
        per[r.doc_id].append(r.p & ((1 << 63) - 1))
    want = {}
    for doc, prints in per.items():
        kept = []
        for p in prints:
            if all((p ^ o).bit_count() >= 10 for o in kept[-50:]):
                kept.append(p)
        want[doc] = len(kept)
    assert {r.doc_id: r.kept for r in catalog.queries()["dup_paragraph_fuzzy"](spark, data).collect()} == want


def test_groups_by_budget_against_a_loop(spark, data):
    from graphloom.functions.text import estimate_tokens

    per = defaultdict(list)
    for r in m.chunks(spark, data).select("doc_id", "chunk_index", estimate_tokens("content").alias("n")).collect():
        per[r.doc_id].append((r.chunk_index, r.n))
    want = set()
    for doc, rows in per.items():
        groups = []
        for _, n in sorted(rows):
            if not groups or groups[-1][0] + n > 500:
                groups.append([0, 0])
            groups[-1][0] += n
            groups[-1][1] += 1
        want |= {(doc, k, c) for k, (_, c) in enumerate(groups)}
    assert {tuple(r) for r in catalog.queries()["chunk_group_budget"](spark, data).collect()} == want


def test_representatives_against_a_loop(spark, data):
    import numpy as np

    per = defaultdict(list)
    for r in m.table(spark, data, "embeddings").select("label", "vec_id", "embedding").collect():
        per[r.label].append((r.vec_id, np.array(r.embedding, float)))
    want = set()
    for label, rows in per.items():
        rows.sort(key=lambda v: v[0])
        points = [v for _, v in rows]
        if len(points) <= 8:
            want |= {(label, i) for i, _ in rows}
            continue
        centres = [points[int(k)] for k in np.linspace(0, len(points) - 1, 8)]
        for _ in range(20):
            homes = [min(range(8), key=lambda k, p=p: ((p - centres[k]) ** 2).sum()) for p in points]
            centres = [np.mean([p for p, h in zip(points, homes, strict=True) if h == k], axis=0) if k in homes else centres[k] for k in range(8)]
        want |= {(label, rows[min(range(len(points)), key=lambda i, k=k: ((points[i] - centres[k]) ** 2).sum())][0]) for k in range(8)}
    assert {tuple(r) for r in catalog.queries()["summarize_select"](spark, data).collect()} == want


def test_semantic_search_against_a_loop(spark, data):
    import math
    import re

    from graphloom.operators.retrieval import hashed_embedding

    asked = "the thing of and that"
    rows = [(r.item_id, r.text) for r in m.table(spark, data, "benchmark").collect()]
    words = sorted({w for _, t in [*rows, (0, asked)] for w in re.findall(r"[^\W_]+", t.lower())})
    signs = {r.w: (r.h % 64, 1 if r.h > 0 else -1) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}

    def vector(text):
        v = [0.0] * 64
        for w in re.findall(r"[^\W_]+", text.lower()):
            at, sign = signs[w]
            v[at] += sign
        return v

    q = vector(asked)
    assert spark.range(1).select(hashed_embedding(F.lit(asked)).alias("v")).first().v == q
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    score = lambda v: max(0.0, min(1.0, sum(a * b for a, b in zip(v, q, strict=True)) / (norm(v) * norm(q)))) if norm(v) else 0.0
    want = sorted(((round(score(vector(t)), 6), i) for i, t in rows), key=lambda v: (-v[0], v[1]))[:10]
    got = [(r.score, r.id) for r in catalog.queries()["search_semantic"](spark, data).orderBy(F.desc("score"), "id").collect()]
    assert [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=1e-6)


def test_idle_timers_of_a_busy_key(spark):
    """Thousands of events of one key: a timer and a look at the whole state for each would take many minutes."""
    from datetime import datetime, timedelta

    q._stateful(spark)
    start, day = datetime(2024, 1, 1), timedelta(hours=24)
    times = [start + timedelta(seconds=30 * i) for i in range(6_000)]
    times += [times[-1] + timedelta(hours=30), times[-1] + timedelta(hours=60)]
    rows = lambda ts: spark.createDataFrame([(1, t) for t in ts], "user_id bigint, ts timestamp_ntz")
    began = time.monotonic()
    found = q.replay_in_turn(spark, [rows(times[:3_000][::-1]), rows(times[3_000:])], lambda e: q.idle(e, "user_id", 24)).select(F.col("last_activity").cast("timestamp_ntz"), F.col("stuck_at").cast("timestamp_ntz"))
    assert sorted(tuple(r) for r in found.collect()) == [(t, t + day) for t in times[5_999:6_001]]
    assert time.monotonic() - began < 60
