"""Deep merges of objects and descriptions against plain loops."""

import json
import random

from pyspark.sql import functions as F
from test_extraction import entities

from graphloom.functions.properties import deep_merged, surer_value
from graphloom.operators import resolution


def made(pick, depth):
    kind = pick.random()
    if depth and kind < 0.5:
        return {k: made(pick, depth - 1) for k in pick.sample("abcd", pick.randint(0, 3))}
    if depth and kind < 0.7:
        return [made(pick, 0) for _ in range(pick.randint(0, 3))]
    return pick.choice([None, 1, 2.5, True, "short", "x" * 25, "y" * 30, ""])


def later(a, b):
    return {k: (later(a[k], b[k]) if k in a and k in b else b[k] if k in b else a[k]) for k in {**a, **b}} if isinstance(a, dict) and isinstance(b, dict) else b


def kept(a, b, a_sure, b_sure):
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: (kept(a[k], b[k], a_sure, b_sure) if k in a and k in b else b[k] if k in b else a[k]) for k in {**a, **b}}
    if isinstance(a, str) and isinstance(b, str):
        return (a if a_sure >= b_sure else b) if min(len(a), len(b)) < 20 else (a if len(a) >= len(b) else b)
    if isinstance(a, list) and isinstance(b, list):
        out = []
        for x in a + b:
            if json.dumps(x) not in map(json.dumps, out):
                out.append(x)
        return out
    return a


def test_deep_merges_against_a_loop(spark):
    pick = random.Random(7)
    rows = [(k, made(pick, 4), made(pick, 4), pick.random(), pick.random()) for k in range(400)]
    rows = [r for r in rows if isinstance(r[1], dict) and isinstance(r[2], dict)]
    table = spark.createDataFrame([(k, json.dumps(a), json.dumps(b), p, q) for k, a, b, p, q in rows], "k int, a string, b string, p double, q double").withColumns({"a": F.parse_json("a"), "b": F.parse_json("b")})
    got = {r.k: (json.loads(r.last), json.loads(r.sure)) for r in table.select("k", F.to_json(deep_merged(F.col("a"), F.col("b"))).alias("last"), F.to_json(deep_merged(F.col("a"), F.col("b"), surer_value(F.col("p"), F.col("q")))).alias("sure")).collect()}
    assert got == {k: (later(a, b), kept(a, b, p, q)) for k, a, b, p, q in rows} and len(rows) > 80


def test_depth_and_what_is_no_object(spark):
    one = lambda a, b, **how: spark.range(1).select(F.to_json(deep_merged(F.parse_json(F.lit(a)), F.parse_json(F.lit(b)), **how)).alias("o")).first().o
    assert json.loads(one('{"a": {"b": {"c": 1}}}', '{"a": {"b": {"d": 2}}}', depth=2)) == {"a": {"b": {"d": 2}}}
    assert json.loads(one('{"a": {"b": {"c": 1}}}', '{"a": {"b": {"d": 2}}}')) == {"a": {"b": {"c": 1, "d": 2}}}
    assert one("[1]", '{"a": null}') == '{"a":null}' and one('{"a": 1}', "3") == "3"


def test_descriptions(spark):
    cases = [
        ("", "b", "b"), (None, "b", "b"), ("a", None, "a"), (None, None, ""), ("cat", "a cat sat", "a cat sat"), ("a cat sat", "cat", "a cat sat"), ("one two three", "three two ONE", "one two three"),
        ("one two", "three four five", "one two. three four five"), ("Done! ", " more here ", "Done! more here"), ("x" * 60, "y", "x" * 50),
        ("A first sentence that is long. Then", "another one of words", "A first sentence that is long. Then."), ("no end", "others that follow it on and on without any end there", "no end. others that follow it on and on without..."),
    ]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string")
    got = {r.k: r.m for r in rows.select("k", resolution.merged_description(F.col("a"), F.col("b"), 50).alias("m")).collect()}
    assert got == {k: m for k, (_, _, m) in enumerate(cases)}


def test_entities_with_nested_properties(spark):
    e = entities(spark, (0, "Ann", "Person", {"confidence": 0.4}), (1, "Anna", "Person", {"confidence": 0.9})).withColumn(
        "properties", F.parse_json(F.when(F.col("ordinal") == 0, '{"tags": ["a", "b"], "home": {"city": "Rome"}, "age": 3}').otherwise('{"tags": ["b", "c"], "home": {"city": "Oslo", "zip": 1}, "job": null}'))
    )
    canonical = spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "source_id bigint, ordinal bigint, canonical bigint")
    got = resolution.merged_entities(e, canonical).select(F.to_json("properties").alias("p")).first().p
    assert json.loads(got) == {"tags": ["a", "b", "c"], "home": {"city": "Oslo", "zip": 1}, "age": 3, "job": None}
