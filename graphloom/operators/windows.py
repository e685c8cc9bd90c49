"""Orders inside groups: ranks, running sums, sampling, look-back."""

from __future__ import annotations

import operator
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom import model as m
from graphloom.catalog import query
from graphloom.operators.ranking import ranks, rrf
from graphloom.operators.relational import sql


@query("rank_rrf", """WITH hits AS (SELECT 'a' AS list, vec_id AS id, vec_id % 17 AS score FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 'b', vec_id, vec_id % 23 FROM embeddings WHERE vec_id % 3 = 0),
  r AS (SELECT list, id, row_number() OVER (PARTITION BY list ORDER BY score DESC, id) AS rank FROM hits) SELECT id, round(sum(1.0 / (60 + rank)), 8) AS score FROM r GROUP BY id""")
def rank_rrf(spark, d):
    e = m.table(spark, d, "embeddings")
    a = e.where("vec_id % 2 = 0").select(F.lit("a").alias("list"), F.col("vec_id").alias("id"), (F.col("vec_id") % 17).alias("score"))
    b = e.where("vec_id % 3 = 0").select(F.lit("b").alias("list"), F.col("vec_id").alias("id"), (F.col("vec_id") % 23).alias("score"))
    return rrf(ranks(a.unionByName(b))).select("id", F.round("score", 8).alias("score"))


def grouped_chunks(chunks: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, group_index, members): groups of ``size`` chunks each ``size - overlap`` on, the last may be shorter.

    A chunk goes to its few groups by arithmetic on its index; nothing is sorted over a document.
    """
    step = max(1, size - overlap)
    low = F.greatest(F.lit(0), F.ceil((F.col("chunk_index") - size + 1) / step))
    exploded = chunks.select("doc_id", "chunk_index", F.explode(F.sequence(low, F.floor(F.col("chunk_index") / step))).alias("group_index"))
    return exploded.groupBy("doc_id", "group_index").agg(F.array_sort(F.collect_list("chunk_index")).alias("members"))


@query("chunk_group_window", sql("SELECT doc_id, g AS group_index, string_agg(chunk_index, ',' ORDER BY chunk_index) AS members FROM (SELECT doc_id, chunk_index, unnest(range(greatest(0, CAST(ceil((chunk_index - 3) / 3) AS BIGINT)), chunk_index // 3 + 1)) AS g FROM chunks) GROUP BY doc_id, g"))
def chunk_group_window(spark, d):
    return grouped_chunks(m.chunks(spark, d), 4, 1).select("doc_id", "group_index", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


def token_groups(chunks: DataFrame, budget: int) -> DataFrame:
    """(doc_id, group_index, chunks): runs of chunks whose tokens fit the budget; a larger chunk stands alone.

    Documents follow each other in a sorted stream, so a task holds a batch of chunks and the last group.
    """
    names = ["doc_id", "group_index", "chunks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used = None, 0
        for batch in batches:
            out = [] if last is None else [last]
            for doc, n in zip(batch.column("doc_id").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                new = not out or out[-1][0] != doc
                if new or used + n > budget:
                    out.append([doc, 0 if new else out[-1][1] + 1, 0])
                    used = 0
                used += n
                out[-1][2] += 1
            last = out.pop() if out else None
            if out:
                yield _groups(out)
        if last is not None:
            yield _groups([last])

    def _groups(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)], names)

    ordered = chunks.select("doc_id", "chunk_index", "tokens").repartition("doc_id").sortWithinPartitions("doc_id", "chunk_index")
    return ordered.mapInArrow(run, "doc_id bigint, group_index int, chunks int")


@query("chunk_group_budget")
def chunk_group_budget(spark, d):
    from graphloom.functions.text import estimate_tokens

    return token_groups(m.chunks(spark, d).select("doc_id", "chunk_index", estimate_tokens("content").alias("tokens")), 500)


@query("depth_sample", sql("SELECT doc_id, chunk_index FROM (SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM chunks) WHERE i % greatest(1, n // 5) = 0 AND i // greatest(1, n // 5) < 5"))
def depth_sample(spark, d):
    """Five groups of each document, evenly spread."""
    c = m.chunks(spark, d).select("doc_id", "chunk_index")
    n = c.groupBy("doc_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 5)).alias("step"))
    return c.join(n, "doc_id").where((F.col("chunk_index") % F.col("step") == 0) & (F.col("chunk_index") / F.col("step") < 5)).select("doc_id", "chunk_index")


def globalised(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations with global ends, dropped per source): chunk-local places of entities become places in the source by the entities of the chunks before.

    ``entities`` has (source_id, chunk_index), ``relations`` (source_id, chunk_index, source, target, anything else). Ends outside their chunk's entities are invalid: such
    relations are dropped and counted as (source_id, dropped). A source has a row per chunk in the window.
    """
    per = entities.groupBy("source_id", "chunk_index").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per.withColumn("_first", F.coalesce(before, F.lit(0).cast("bigint")))
    met = relations.join(offsets, ["source_id", "chunk_index"], "left")
    inside = lambda c: F.coalesce((F.col(c) >= 0) & (F.col(c) < F.col("_n")), F.lit(False))
    fine = inside("source") & inside("target")
    good = met.where(fine).withColumns({c: F.col("_first") + F.col(c) for c in ("source", "target")}).select(*relations.columns)
    return good, met.groupBy("source_id").agg(F.count_if(~fine).alias("dropped"))


_LOCAL = "l AS (SELECT source_id, chunk_index, ordinal, ordinal % 4 AS s, ordinal * 7 % 5 - 1 AS t FROM claims), p AS (SELECT source_id, chunk_index, count(*) AS n FROM mentions GROUP BY ALL), o AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY source_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS f FROM p)"


def _local(spark, d):
    places = m.claims(spark, d).select("source_id", "chunk_index", "ordinal", (F.col("ordinal") % 4).alias("source"), (F.col("ordinal") * 7 % 5 - 1).alias("target"))
    return globalised(m.mentions(spark, d).select("source_id", "chunk_index"), places)


@query("offset_aggregate", sql(f"WITH {_LOCAL} SELECT ordinal, f + s AS source, f + t AS target FROM l JOIN o USING (source_id, chunk_index) WHERE s < n AND t BETWEEN 0 AND n - 1"))
def offset_aggregate(spark, d):
    """Ends of relations counted within chunks, as places within sources."""
    return _local(spark, d)[0].select("ordinal", "source", "target")


@query("offset_dropped", sql(f"WITH {_LOCAL} SELECT source_id, count(*) FILTER (WHERE NOT coalesce(s < n AND t BETWEEN 0 AND n - 1, false)) AS dropped FROM l LEFT JOIN o USING (source_id, chunk_index) GROUP BY 1"))
def offset_dropped(spark, d):
    return _local(spark, d)[1]


def lookback(paragraphs: DataFrame, key: Column, same: Callable, back: int = 50) -> DataFrame:
    """(doc_id, kept): how many paragraphs of each document are unlike all of the last ``back`` kept before them, by ``same`` of two keys.

    A document's keys, one number a paragraph, are one row.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, keys in zip(frame["doc_id"], frame["keys"], strict=True):
                kept: deque[int] = deque(maxlen=back)
                n = 0
                for k in keys:
                    if not any(same(k, other) for other in kept):
                        kept.append(k)
                        n += 1
                out.append((doc, n))
            yield pd.DataFrame(out, columns=["doc_id", "kept"])

    ordered = paragraphs.select("doc_id", "chunk_index", key.alias("k")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "k"))).alias("x"))
    return ordered.select("doc_id", F.transform("x", lambda x: x["k"]).alias("keys")).mapInPandas(run, "doc_id bigint, kept bigint")


@query("dup_paragraph_lookback", sql("SELECT doc_id, CAST(len(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(ks, lambda k: [k])), lambda acc, x: CASE WHEN list_contains(acc[greatest(1, len(acc) - 49):], x[1]) THEN acc ELSE acc || x END)) AS BIGINT) AS kept FROM (SELECT doc_id, list(md5(lower(trim(content))) ORDER BY chunk_index) AS ks FROM chunks GROUP BY doc_id)"))
def dup_paragraph_lookback(spark, d):
    """Equal paragraphs but for case and blanks around them."""
    return lookback(m.chunks(spark, d), F.xxhash64(F.lower(F.trim("content"))), operator.eq)


def _alike(a: int, b: int, bits: int = 10) -> bool:
    return (a ^ b).bit_count() < bits


@query("dup_paragraph_fuzzy")
def dup_paragraph_fuzzy(spark, d):
    """Paragraphs whose fingerprints differ by less than ten bits; tested against a plain loop."""
    from graphloom.functions.text import simhash

    return lookback(m.chunks(spark, d), simhash(F.split(F.lower("content"), " ")).bitwiseAND(F.lit((1 << 63) - 1)), _alike)


@query("attempts_history", sql("SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY id) AS attempt FROM metrics"))
def attempts_history(spark, d):
    x = m.metrics(spark, d)
    return x.select("user_id", "id", F.row_number().over(Window.partitionBy("user_id").orderBy("id")).cast("bigint").alias("attempt"))


@query("recency_messages", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3")
def recency_messages(spark, d):
    c = m.table(spark, d, "conversations")
    return c.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("k <= 3").select("conv_id", "turn")


@query("context_budget", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(4 + CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 300")
def context_budget(spark, d):
    """The newest messages whose tokens, four more each, fit together."""
    from graphloom.functions.text import estimate_tokens

    used = F.sum(4 + estimate_tokens("text")).over(Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    return m.table(spark, d, "conversations").withColumn("used", used).where("used <= 300").select("conv_id", "turn")
