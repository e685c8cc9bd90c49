"""The driver's entry points and the streamed queries against their batch forms."""

import __spark_entry__ as entry_points


def test_entry(spark):
    rows = entry_points.entry(spark)
    assert rows.columns == ["id", "label", "incoming", "outgoing", "total", "edge_types", "citations"] and rows.count() > 0


def test_queries_and_sql_agree_on_names():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_fan_in_claims_once(spark, data):
    found = entry_points.queries()
    assert sorted(found["job_fan_in"](spark, data).collect()) == sorted(found["job_fan_in_batch"](spark, data).collect())
