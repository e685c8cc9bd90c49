"""Rank fusion and unions of scored lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_max(*hits: DataFrame) -> DataFrame:
    """(id, score): the highest score of each id over lists (id, score)."""
    return reduce(DataFrame.unionByName, hits).groupBy("id").agg(F.max("score").alias("score"))


def rrf(ranked: DataFrame, k: int = 60) -> DataFrame:
    """(id, score) of rows (list, id, rank): the sum of 1 / (k + rank) over lists."""
    return ranked.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def ranks(hits: DataFrame, by: str = "list") -> DataFrame:
    """Add the place of each row (list, id, score) in its list, from 1, by score and id."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id")))
