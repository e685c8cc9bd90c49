"""Repeated passages by seed and extend.

Seeds are winnowed anchors: of the eight-word shingles in each window of 20 words the one with the
smallest hash. Equal windows choose equal anchors, so windows are compared only below
equal anchors. Consecutive windows with one anchor form its stretch, the text that the anchor reaches
both ways. An occurrence whose whole stretch equals an earlier one is a repeat at once; only
where stretches around one anchor differ, at the ends of repeats, windows are compared singly, and of
each different stretch only the earliest occurrence. The repeats of a document are the unions of its
repeated windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import join_counted, rows_of, slices, text_key
from graphloom.llm.rolling import Texts, WordHash
from graphloom.plans.scratch import discard, materialise, materialise_at

WINDOW = 20
ANCHOR = 8
#: Distinct anchors of a bucket that one task compares.
BUCKET = 500_000
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


class Passages(Texts):
    """Stretches of a list of texts."""

    def __init__(self, texts: list[str | None], hashes: WordHash):
        super().__init__(texts, _WORDS.findall, hashes)

    def stretches(self, window: int, anchor: int) -> tuple[np.ndarray, ...]:
        """(text, first window, windows, anchor hash, hash of the stretch) by text and place."""
        starts, text = self.windows(window)
        if not len(starts):
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        last = len(self.words) + 1 - anchor
        at = np.arange(max(last, 0))
        grams = self.runs(at, at + anchor)
        # leftmost minimum of each run of grams, by doubling its reach
        reach, low = 1, at.copy()
        span = window - anchor + 1

        def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.where(grams[b] < grams[a], b, a)

        while 2 * reach <= span:
            m = len(low) - reach
            low = np.concatenate([merged(low[:m], low[reach:]), low[m:]])
            reach *= 2
        anchors = merged(low[starts], low[starts + span - reach])
        new = np.ones(len(starts), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(starts)))
        first = starts[heads]
        return text[heads], first - self.begins[text[heads]], sizes, grams[anchors[heads]], self.runs(first, first + sizes + window - 1)


_ROW = "a bigint, f bigint, doc_id bigint, t bigint, first int, n int"


def _anchor_blobs(docs: DataFrame, buckets: int, window: int, anchor: int) -> DataFrame:
    """Rows (bucket, blob) of packed anchors, and loose rows (bucket -1) known to be repeated.

    Of occurrences of one anchor in a slice the first goes to the anchor's bucket, the others
    stay loose; so a bucket gets at most one row of an anchor from each slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, compress = WordHash(), zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            passages = Passages(batch.column("text").to_pylist(), hashes)
            text, first, n, a, f = passages.stretches(window, anchor)
            ids = batch.column("doc_id")
            null = np.asarray(ids.is_null())[text]
            packed = np.zeros(len(text), _PACKED)
            for name, values in (("a", a), ("f", f), ("doc_id", np.asarray(ids.fill_null(0))[text]), ("t", np.asarray(batch.column("t"))[text]), ("first", first), ("n", n), ("null", null)):
                packed[name] = values.view(np.int64) if values.dtype == np.uint64 else values
            _, once, times = np.unique(a, return_index=True, return_counts=True)
            alone = np.zeros(len(a), bool)
            alone[once] = True
            packed["known"][once[times > 1]] = 1
            where = np.where(alone, (a % np.uint64(buckets)).astype(np.int64), -1)
            order = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.diff(where[order])) + 1
            groups = np.split(order, cuts) if len(order) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(where[g[0]]) for g in groups], pa.int64()), pa.array([compress(_columns(packed[g])) for g in groups], pa.binary())],
                ["bucket", "blob"],
            )

    return rows_of(docs, "doc_id", "text").withColumn("t", text_key("text")).mapInArrow(run, "bucket bigint, blob binary")


_PACKED = np.dtype([("a", "<i8"), ("f", "<i8"), ("doc_id", "<i8"), ("t", "<i8"), ("first", "<i4"), ("n", "<i4"), ("null", "i1"), ("known", "i1")])


def _columns(rows: np.ndarray) -> bytes:
    """Column after column: runs of one document compress to nearly nothing."""
    return len(rows).to_bytes(8, "little") + b"".join(np.ascontiguousarray(rows[name]).tobytes() for name in rows.dtype.names)


def _unpacked(blob: bytes) -> np.ndarray:
    n, at = int.from_bytes(blob[:8], "little"), 8
    rows = np.empty(n, _PACKED)
    for name in _PACKED.names:
        kind = _PACKED[name]
        rows[name] = np.frombuffer(blob, kind, n, at)
        at += n * kind.itemsize
    return rows


def _as_batch(rows: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame({name: rows[name] for name in ("a", "f", "doc_id", "t", "first", "n")})
    out["doc_id"] = out["doc_id"].astype("Int64").mask(rows["null"].astype(bool))
    return out


def _repeated(docs: DataFrame, window: int, anchor: int, held) -> DataFrame:
    """Every occurrence (a, f, doc_id, t, first, n) of an anchor that occurs more than once, written by ``held``."""
    words = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = 1 + words // (40 * BUCKET)  # an anchor in seven words of about six characters
    blobs, path = materialise_at(_anchor_blobs(docs, buckets, window, anchor), "anchors")

    def loose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decompress = zstandard.ZstdDecompressor().decompress
        for frame in frames:
            for blob in frame["blob"]:
                yield _as_batch(_unpacked(decompress(blob)))

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        decompress = zstandard.ZstdDecompressor().decompress
        rows = np.concatenate([_unpacked(decompress(b)) for b in frame["blob"]])
        _, inverse, times = np.unique(rows["a"], return_inverse=True, return_counts=True)
        return _as_batch(rows[(times[inverse] > 1) | (rows["known"] == 1)])

    found = held(blobs.where("bucket = -1").mapInPandas(loose, _ROW).unionByName(blobs.where("bucket >= 0").groupBy("bucket").applyInPandas(compare, _ROW)), "repeated")
    discard(docs.sparkSession, path)
    return found


def _spot(*names: str) -> F.Column:
    """Order of places: null ids first, then by id, text hash and word."""
    return F.struct(F.col("doc_id").isNotNull().alias("known"), *[F.col(n) for n in ("doc_id", "t", *names)])


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, t, gone): per document the runs (first, n) of ``n`` windows from word ``first`` that each start earlier elsewhere."""
    spent: list[str] = []

    def held(df: DataFrame, tag: str) -> DataFrame:
        table, path = materialise_at(df, tag)
        spent.append(path)
        return table

    found = _repeated(docs, window, anchor, held)
    classes = held(
        found.groupBy("a", "f").agg(F.min(_spot("first", "n")).alias("head"), F.count("*").alias("times")), "stretches"
    )
    again = (
        join_counted(found, classes.where("times > 1"), ["a", "f"], found.count())  # the commonest stretches stay where they are
        .where(~_spot("first", "n").eqNullSafe(F.col("head")))
        .select("doc_id", "t", "first", "n")
    )
    several = classes.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1").select("a")
    heads = classes.join(several, "a").select("a", "head.doc_id", "head.t", "head.first", "head.n")
    wanted = heads.groupBy("doc_id", "t").agg(F.collect_list(F.struct("a", "first", "n")).alias("wanted"))
    texts = rows_of(docs, "doc_id", "text").withColumn("t", text_key("text"))
    asked = _with(texts, wanted, "wanted", "inner")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unpack = WordHash(), zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "z", 1_500_000):
            passages = Passages([unpack(z).decode() for z in batch.column("z").to_pylist()], hashes)
            rows = [(i, w["a"], w["first"], w["n"]) for i, ws in enumerate(batch.column("wanted").to_pylist()) for w in ws]
            i, a, first, n = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
            which = np.repeat(np.arange(len(n)), n)
            place = first[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = passages.begins[i[which]] + place
            take = pa.array(i[which])
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[which]), pa.array(passages.runs(at, at + window).view(np.int64)), batch.column("doc_id").take(take), batch.column("t").take(take), pa.array(place.astype(np.int32))],
                ["a", "w", "doc_id", "t", "first"],
            )

    singles = held(asked.mapInArrow(expand, "a bigint, w bigint, doc_id bigint, t bigint, first int"), "windows")
    earliest = singles.groupBy("a", "w").agg(F.min(_spot("first")).alias("head"), F.count("*").alias("times")).where("times > 1")
    single = singles.join(earliest, ["a", "w"]).where(~_spot("first").eqNullSafe(F.col("head"))).select("doc_id", "t", "first", F.lit(1).alias("n"))
    gone = materialise(again.unionByName(single).groupBy("doc_id", "t").agg(F.collect_list(F.struct("first", "n")).alias("gone")), "gone")
    for path in spent:
        discard(docs.sparkSession, path)
    return gone


def _zipped(texts: DataFrame) -> DataFrame:
    """Texts as zstandard frames: a third of the bytes to shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            zipped = pa.array([compress((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), zipped], ["doc_id", "t", "z"])

    return texts.mapInArrow(run, "doc_id bigint, t bigint, z binary")


def _with(texts: DataFrame, found: DataFrame, column: str, how: str) -> DataFrame:
    """Join (doc_id, t, column) to compressed texts; a null id equals a null id."""
    left, right = _zipped(texts).alias("l"), found.alias("r")
    return left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.t") == F.col("r.t")), how).select("l.doc_id", "l.t", "l.z", f"r.{column}")


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of each row of ``docs`` (doc_id, text).

    Words are runs without ASCII white space. Each word covered by a window of ``window`` words whose sequence also
    starts earlier (smaller doc_id, or same document and earlier word) is removed, judged on the
    input. Null and empty texts have no words and the hash of the empty string. Rows equal in
    doc_id and text are one document; others that share an id are ordered by their text's hash, null ids come first.
    """
    gone = repeats(docs, window, anchor)
    texts = rows_of(docs, "doc_id", "text").withColumn("t", text_key("text"))
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "z", 1_500_000):
            out: list[list] = [[], [], [], []]
            for z, spans in zip(batch.column("z").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                words = _WORDS.findall(unpack(z).decode())
                total = len(words)
                if spans:
                    edge = np.zeros(total + 1, np.int64)
                    np.add.at(edge, [s["first"] for s in spans], 1)
                    np.add.at(edge, [s["first"] + s["n"] + window - 1 for s in spans], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                kept = " ".join(words)
                for column, value in zip(out, (total, total - len(words), hashlib.sha256(kept.encode()).hexdigest(), kept), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()][: 3 + with_text]
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text])

    return _with(texts, gone, "gone", "left").mapInArrow(cut, schema)
