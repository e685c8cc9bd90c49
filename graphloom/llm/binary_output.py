"""Token ids as bit planes: blocks of ids, transposed and compressed plane by plane.

A file of the format is a Parquet file of the ``blocks`` table: each row is a block of
``block_ids`` consecutive ids (the last of a part may be shorter) as one zstandard frame
per bit plane. Plane b holds bit b of every id, eight ids a byte, so that high planes,
nearly constant, shrink to a few bytes. Beside it lie ``index`` (a row per block: part, block,
first id, ids, bytes of each plane) and ``docs`` (a row per document: part, place in the part, ids before
it in the part, ids). Parts are ranges of doc_id in ascending order. Spark writes and
commits all three, so any store that Spark reaches can hold them and a lost task is redone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import rows_of, slices, text_key
from graphloom.llm.encoding import encoder
from graphloom.plans.scratch import materialise, scratch_path

BLOCK = 1 << 16
END_ID = 2
_STORED = "part int, block int, first bigint, n_ids int, planes array<binary>, doc_id array<bigint>, place array<bigint>, start array<bigint>, length array<bigint>"


def to_planes(ids: np.ndarray, compress) -> list[bytes]:
    """Bit planes of ids, from the lowest to the highest that holds a set bit."""
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    return [compress(np.packbits(((ids >> b) & 1).astype(np.uint8)).tobytes()) for b in range(width)]


def from_planes(planes: list[bytes], n: int, decompress) -> np.ndarray:
    ids = np.zeros(n, dtype=np.uint32)
    for b, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(decompress(plane), np.uint8), count=n).astype(np.uint32) << np.uint32(b)
    return ids


def write_ids(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end_id: int = END_ID, block_ids: int = BLOCK, parts: int | None = None) -> None:
    """Write ``docs`` (doc_id, text) to ``folder`` in ascending doc_id order, null ids first.

    Null text is empty: its document has the end id alone. Rows that repeat a doc_id are
    stored each, ordered by their text's hash. An empty table gives empty files.
    """
    path = public_tokenizers.path(tokenizer)
    spark = docs.sparkSession
    # as many parts as the input has splits, so that parts keep their size
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    level = 3

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids_of, end = encoder(path, keep_space=False), int(end_id).to_bytes(4, "little")
        compress = zstandard.ZstdCompressor(level=level).compress
        held, documents, first, block, place, at = bytearray(), [[], [], [], []], 0, 0, 0, 0

        def flush(n: int) -> pa.RecordBatch:
            nonlocal first, block, documents
            ids = np.frombuffer(bytes(held[: 4 * n]), "<u4")
            row = [[part], [block], [first], [n], [to_planes(ids, compress)], *[[x] for x in documents]]
            del held[: 4 * n]
            first, block, documents = first + n, block + 1, [[], [], [], []]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.binary()), *[pa.list_(pa.int64())] * 4]
            names = ["part", "block", "first", "n_ids", "planes", "doc_id", "place", "start", "length"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names)

        for batch in slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = ids_of(text) + end
                for column, value in zip(documents, (doc, place, at, len(ids) // 4), strict=True):
                    column.append(value)  # with the block in which the document starts
                held += ids
                at += len(ids) // 4
                place += 1
                while len(held) >= 4 * block_ids:
                    yield flush(block_ids)
        if held:
            yield flush(len(held) // 4)

    rows = rows_of(docs, "doc_id", "text").select("doc_id", "text", text_key("text").alias("t"), F.monotonically_increasing_id().alias("row"))
    # rows that share an id, equal ones too, may go to several parts
    ordered = rows.repartitionByRange(parts, "doc_id", "t", "row").sortWithinPartitions("doc_id", "t").select("doc_id", "text")
    ordered.mapInArrow(encode, _STORED).write.parquet(f"{folder}/all")
    stored = spark.read.schema(_STORED).parquet(f"{folder}/all")
    stored.select("part", "block", "first", "n_ids", F.transform("planes", lambda x: F.length(x)).alias("bytes")).write.parquet(f"{folder}/index")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 of its decoded ids.

    Blocks are decoded wherever they lie; of a document in several, the checksums of its
    stretches are combined.
    """
    stored = spark.read.schema(_STORED).parquet(f"{folder}/all")
    index = spark.read.parquet(f"{folder}/index")
    sizes = index.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint").alias("before"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in batch.to_pylist():
                n, first = row["n_ids"], row["first"]
                ids = memoryview(from_planes(row["planes"], n, decompress).astype("<u4").tobytes())
                starts = row["start"]
                head = min(starts[0] - first, n) if starts else n
                out = [(None, None, first, first, head, zlib.crc32(ids[: 4 * head]))] if head else []
                for doc, place, start, length in zip(row["doc_id"], row["place"], starts, row["length"], strict=True):
                    stop = min(start + length, first + n)
                    out.append((doc, place, start, length, stop - start, zlib.crc32(ids[4 * (start - first) : 4 * (stop - first)])))
                columns = list(zip(*out, strict=True)) if out else [()] * 6
                kinds = [pa.int64()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(out), pa.int32()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                    ["part", "doc_id", "place", "start", "length", "got", "crc"],
                )

    # a stretch without a document continues one that starts in an earlier block
    stretches = materialise(stored.mapInArrow(decode, "part int, doc_id bigint, place bigint, start bigint, length bigint, got bigint, crc bigint"), "stretches")
    whole = stretches.where("place is not null and got = length")
    broken = stretches.where("place is null or got < length")

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, out, open_ = rows.sort_values("start", kind="stable"), [], None
        for doc, place, start, length, got, crc in rows[["doc_id", "place", "start", "length", "got", "crc"]].itertuples(index=False, name=None):
            if pd.notna(place):
                open_ = [key[0], doc, place, start, length, got, crc]
                out.append(open_)
            else:
                open_[6] = crc32_combine(int(open_[6]), int(crc), 4 * int(got))
                open_[5] += got
        assert all(x[4] == x[5] for x in out), "a block is missing"
        return pd.DataFrame(out, columns=["part", "doc_id", "place", "start", "length", "got", "crc"]).astype({"doc_id": "Int64"})

    # a part holds at most one such stretch per block, and a block is 65,536 ids
    joined = broken.groupBy("part").applyInPandas(join, stretches.schema)
    return (
        whole.unionByName(joined)
        .join(F.broadcast(before), "part")  # a row per part: as many as the partitions of one shuffle
        .select("doc_id", (F.col("before") + F.col("start")).alias("start"), F.col("length").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    )


def crc32_combine(a: int, b: int, length: int) -> int:
    """CRC-32 of A + B from those of A and of B, which is ``length`` bytes long.

    Appending zeros multiplies by a power of x modulo the CRC's polynomial.
    """

    def times(p: int, q: int) -> int:
        product = 0
        for i in range(32):  # bit 31 is the coefficient of x^0
            if p >> (31 - i) & 1:
                product ^= q
            q = (q >> 1) ^ (0xEDB88320 if q & 1 else 0)
        return product

    shift, square, bits = 1 << 31, 1 << 23, length  # 1 and x^8
    while bits:
        if bits & 1:
            shift = times(shift, square)
        square = times(square, square)
        bits >>= 1
    return times(shift, a) ^ b


def token_binary(docs: DataFrame, **how) -> DataFrame:
    """Write ``docs`` to a folder of the shared directory and read them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write_ids(docs, folder, **how)
    return read_ids(docs.sparkSession, folder)
