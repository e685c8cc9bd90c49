"""Exact deduplication against a persistent index of digests, bucketed and sorted by digest.

The index is a folder of Parquet files with one row per distinct text ever taken in. A batch is reduced to its distinct
digests, those are anti-joined with the index by sort and merge, and only the new ones are appended. The index side of that join is
never shuffled: its buckets are the join's partitions, and what is appended falls into the same buckets. Texts are read once,
to be hashed; everything later moves digests of 32 bytes.

A batch that is taken in again, after a failure say, finds its digests present and appends nothing, so retries are safe.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import join_counted, rows_of
from graphloom.plans.scratch import discard, materialise_at, scratch_path

#: Batches in which the query takes its table in, each against what those before it left in the index.
BATCHES = 3


def normalised(text: Column) -> Column:
    """Each run of blanks as one blank; null is empty. Texts in which only single blanks occur are passed on unread by the pattern."""
    text = F.coalesce(text, F.lit(""))
    plain = ~text.contains("  ")
    for mark in "\t\n\x0b\x0c\r":
        plain = plain & ~text.contains(mark)
    return F.when(plain, text).otherwise(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def digested(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of each row: the SHA-256, as 32 bytes, of its normalised text."""
    return rows_of(docs, "doc_id", "text").select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))


class DigestIndex:
    """The index in the folder ``path``, shared by all machines; a folder that holds none yet starts an empty one.

    ``buckets`` must stay the same over the index's life: 128 MB of index each, or some three million texts, is a good size.
    The table's name lives in the session's catalog only; the folder is the index, whichever session opens it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.name = spark, path, f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, doc_id BIGINT) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        """(digest, doc_id): each known text and the row that stays for it."""
        return self.spark.table(self.name)

    def add(self, digests: DataFrame) -> None:
        """Append those of ``digests`` (doc_id, digest) that the index lacks, each with its smallest doc_id.

        Partial aggregation brings any number of copies down to one row per task before they are shuffled. A text that
        an earlier batch brought keeps that batch's row, whatever ids come later; null ids give way to others of their batch.
        """
        heads = digests.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
        heads.join(self.table().hint("merge"), "digest", "left_anti").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def found(self, classes: DataFrame) -> DataFrame:
        """``classes`` (digest, one row each) with keep_id, the row that stays; digests not taken in have none."""
        return classes.join(self.table().withColumnRenamed("doc_id", "keep_id").hint("merge"), "digest", "left")

    def close(self) -> None:
        """Forget the table's name; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def decided(digests: DataFrame, index: DigestIndex) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) of each row of the written table ``digests``, all taken into ``index``.

    Rows equal in doc_id and digest are told apart by a number, so of repeated rows too just one stays. Classes of one
    row need no join; in the others, classes of very many rows are broadcast and their rows stay where they are.
    """
    rows = digests.groupBy("digest", "doc_id").agg(F.count("*").alias("same"))
    classes, path = materialise_at(
        index.found(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.sum("same").alias("group_size"), F.count("*").alias("times"))), "classes"
    )
    total = classes.agg(F.sum("times")).first()[0] or 0
    out = ("doc_id", "keep_id", "group_size", "same", "digest")
    alone = classes.where("times = 1").select(F.col("first").alias("doc_id"), "keep_id", "group_size", F.col("group_size").alias("same"), "digest")
    shared = classes.where("times > 1").select("digest", "keep_id", "group_size", "times")
    met = join_counted(rows, shared, ["digest"], total)
    each = alone.unionByName(met.select(*out)).select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "same")).alias("number"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("number") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = BATCHES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row, dropped ones too.

    Texts are equal when their normalised forms have one SHA-256; null is empty, white space alone is one blank. Of equal texts
    the smallest doc_id stays: ``batches`` are taken in by rising doc_id, rows without an id last, so keep_id is null only where no
    row of a group has one. Of rows repeated with one id, one stays. Other columns of ``docs``, whatever their names, don't matter; an
    empty table gives an empty result. With an ``index`` that already knows texts their rows stay and these go; group_size
    counts ``docs`` alone. Without one, an empty index serves this table and is deleted.
    """
    spark = docs.sparkSession
    digests, _ = materialise_at(digested(docs), "digests")
    path = None
    if index is None:
        path = scratch_path(spark, "digest-index")
        index = DigestIndex(spark, path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = digests.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)]).alias("cuts")).first().cuts if batches > 1 else None
    cuts = sorted(set(cuts or []))
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = digests.where("doc_id is not null")
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        index.add(batch)
    index.add(digests.where("doc_id is null"))
    result = decided(digests, index)
    if path:
        index.close()
        discard(spark, path)
    return result.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
