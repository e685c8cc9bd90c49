"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 segments of two bits, written
in unary (00, 01, 11), so that the Manhattan distance of two embeddings is the number of
differing bits of the codes. It never exceeds the Hamming distance of the fingerprints.
Codes are cut into blocks of whole segments. Within distance d at most d blocks differ, so two
linked codes agree on some blocks - d of them: each such choice is a dimension of the grid, its
blocks' bits a cell, and a range join inside cells misses no pair. More blocks make finer cells; their
number follows the number of distinct fingerprints, which keeps cells small at every size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import is_row, join_counted, rows_of, slices, text_key, without
from graphloom.plans.fixpoint import connected_components
from graphloom.plans.scratch import discard, materialise, materialise_at
from graphloom.plans.spread import unsized

MAX_BITS = 4
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_EVEN = 0x5555555555555555


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """XXH64 (seed 42) of the word shingles, repeats included; of all words if they are fewer."""
    words = text.encode().translate(_LOWER).split() if text else []  # bytes split at ASCII white space alone
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    return [digest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: list[int]) -> int:
    """Bits set in over half of the hashes, as a signed long; 0 without any."""
    if not hashes:
        return 0
    columns = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp) of each row; null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fp"])

    return rows_of(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("bigint")


def embed(fp: Column) -> Column:
    """Unary codes of the bit counts of the two-bit segments."""
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(_long(_EVEN)).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(_long(_EVEN)), 1))


def _blocks(n: int) -> list[int]:
    """Masks of n blocks of whole segments, nearly equal."""
    edges = [round(i * 32 / n) * 2 for i in range(n + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(src, dst) with src < dst: every pair of fingerprints at most ``max_bits`` apart, once.

    ``distinct`` (fp) holds each fingerprint once, so copies meet no pair.
    """
    n = distinct.count()
    blocks = max_bits + 2
    while n >> (9 * (blocks - max_bits)) and blocks < 16:  # about nine bits of a block tell fingerprints apart
        blocks += 1
    masks = _blocks(blocks)
    cells = list(combinations(range(blocks), blocks - max_bits))
    coded = distinct.select("fp", embed(F.col("fp")).alias("code"))
    keys = [F.struct(F.lit(k).alias("k"), F.col("code").bitwiseAND(_long(sum(masks[b] for b in c))).alias("cell")) for k, c in enumerate(cells)]
    gridded = coded.select("fp", "code", F.explode(F.array(*keys)).alias("at")).select("fp", "code", "at.k", "at.cell")
    a, b = gridded.alias("a"), unsized(gridded).alias("b")
    apart = F.col("a.code").bitwiseXOR(F.col("b.code"))
    # a pair is reported by the first choice of blocks on which it agrees: no earlier block agrees besides
    first = F.lit(False)
    for k, c in enumerate(cells):
        others = [x for x in range(c[-1]) if x not in c]
        alone = F.lit(True)
        for x in others:
            alone = alone & (apart.bitwiseAND(_long(masks[x])) != 0)
        first = first | ((F.col("a.k") == k) & alone)
    return a.join(
        b,
        (F.col("a.k") == F.col("b.k"))
        & (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(apart) <= max_bits)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits)
        & first,
    ).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs`` (doc_id, text).

    Null, empty and wordless texts have fingerprint zero and link like any other. Equal
    fingerprints form one class; classes link at ``max_bits`` or fewer differing bits, and component_id
    is the smallest doc_id reachable. Null ids join groups but name none (a group of only
    null ids has a null component). Repeated rows are returned each.
    """
    prints = materialise(fingerprints(docs, shingle), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("times")), "classes")
    reach = connected_components(links(classes.select("fp"), max_bits))
    grouped = classes.join(reach, classes.fp == reach.node).select("fp", "low", "component")
    lows = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    merged = grouped.join(lows, "component").select("fp", "component_id")
    named = materialise(classes.join(merged, "fp", "left").select("fp", "times", F.coalesce("component_id", "low").alias("component_id")), "named")
    return join_counted(prints, named, ["fp"], prints.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _bands(least: float, recall: float) -> tuple[int, int]:
    """(bands, minima of each) by which sets of Jaccard similarity ``least`` agree on a band with probability ``recall``.

    Two sets agree on a minimum with their similarity, each time anew, so the recall is that of every pair and at
    every table size. Bands are as long as about one in six is agreed on.
    """
    if least >= 1:
        return 1, 1
    long = max(1, round(math.log(1 / 6) / math.log(least)))
    return math.ceil(math.log(1 - recall) / math.log(1 - least**long)), long


@lru_cache
def _bijections(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of n maps of 32-bit hashes, one a row."""
    random = np.random.default_rng(64)
    return random.integers(0, 1 << 31, (n, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1), random.integers(0, 1 << 32, (n, 1), dtype=np.uint32)


def band_hashes(hashes: list[int], bands: int, long: int) -> np.ndarray:
    """A hash per band of ``long`` smallest values, each under a random bijection of 32-bit hashes."""
    times, plus = _bijections(bands * long)
    values = np.array(hashes, dtype="<u8").astype(np.uint32)
    low = np.full(bands * long, (1 << 32) - 1, np.uint32)
    for k in range(0, len(values), 2048):  # a slice stays in the cache
        low = np.minimum(low, (values[k : k + 2048] * times + plus).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.astype("<u4").reshape(bands, long))], np.uint64).view(np.int64)


def _shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, shingles): the sorted 64-bit hashes of each text's distinct shingles, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "z", 1_500_000):
            sets = [np.unique(np.array(shingle_hashes(unpack(z).decode(), shingle), dtype="<u8")).tobytes() for z in batch.column("z").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])

    return docs.mapInArrow(run, "id bigint, shingles binary")


def _similar(pairs: DataFrame, zipped: DataFrame, shingle: int, least: float, held) -> DataFrame:
    """Those of ``pairs`` (src, dst) whose shingle sets have a Jaccard similarity of at least ``least``."""
    needed = held(pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct(), "needed")
    sets = held(_shingle_sets(zipped.join(needed, "id").select("id", "z"), shingle), "shingles")
    both = pairs.join(sets.select(F.col("id").alias("src"), F.col("shingles").alias("a")), "src").join(sets.select(F.col("id").alias("dst"), F.col("shingles").alias("b")), "dst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                common = len(np.intersect1d(a, b, assume_unique=True))
                kept.append(common >= least * (len(a) + len(b) - common))
            yield batch.select(["src", "dst"]).filter(pa.array(kept))

    return held(both.select("src", "dst", "a", "b").mapInArrow(run, "src bigint, dst bigint"), "similar")


def _order() -> Column:
    """Which document stays: the smallest doc_id, of those the smallest hash of the text; null ids last."""
    return F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "t", "id")


def _near_ids(classes: DataFrame, max_bits: int, held) -> DataFrame:
    """(src, dst): links of ``classes`` (low, fp) by their fingerprints, equal ones to the first of them, others as :func:`links` finds them."""
    heads = held(classes.groupBy("fp").agg(F.min("low.id").alias("head")), "heads")
    equal = classes.join(heads, "fp").select(F.col("low.id").alias("src"), F.col("head").alias("dst")).where("src <> dst")
    apart = held(links(heads.select("fp"), max_bits), "apart")
    named = lambda end: heads.select(F.col("fp").alias(end), F.col("head").alias(f"{end}_head"))
    return equal.unionByName(apart.join(named("src"), "src").join(named("dst"), "dst").select(F.col("src_head").alias("src"), F.col("dst_head").alias("dst")))


def similar_groups(docs: DataFrame, shingle: int = 5, least: float = 0.8, recall: float = 0.97, max_bits: int | None = None, print_shingle: int = 4) -> DataFrame:
    """(doc_id, t, component_id, first) of each row in a group of similar texts: its id and the hash of its text, the smallest
    doc_id of its group, and whether it is the row that stays for the group.

    With ``max_bits`` texts link as :func:`near_duplicates` links them: by fingerprints of ``print_shingle`` words at most so many bits
    apart. Texts also link if their sets of word shingles are ``least`` alike (Jaccard, exactly). Fingerprints of such pairs
    differ in some 10 bits at 0.8, which no grid finds. Candidates for these are texts that share a band of
    smallest shingle hashes, ``recall`` of the pairs at the similarity itself, whatever the table's size. Equal texts
    collapse first. Large cells come to few pairs: first each text meets only the smallest of its cells, and then only
    cells of texts that this has not joined are paired. Null and wordless texts are in no group. Rows are told apart by
    themselves, not by doc_id: repeated rows, ids on several texts and null ids are each a row of their group, and one of all of
    them stays.
    """
    bands, long = _bands(least, recall)
    rows = rows_of(docs, "doc_id", "text").where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("doc_id", "text", text_key("text").alias("t"), F.monotonically_increasing_id().alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            keys, prints, cells, zipped = [], [], [], []
            for text in texts:
                hashes = shingle_hashes(text, shingle)
                prints.append(0 if max_bits is None else fingerprint(text, print_shingle))
                keys.append(xxhash.xxh128_digest(np.array(hashes, dtype="<u8").tobytes()))
                cells.append(band_hashes(hashes, bands, long))
                zipped.append(compress(text.encode()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("doc_id"), batch.column("t"), pa.array(keys, pa.binary()), pa.array(prints, pa.int64()), pa.array(cells, pa.list_(pa.int64())), pa.array(zipped, pa.binary())],
                ["id", "doc_id", "t", "same", "fp", "cells", "z"],
            )

    spent: list[str] = []

    def held(df: DataFrame, tag: str) -> DataFrame:
        table, path = materialise_at(df, tag)
        spent.append(path)
        return table

    # ids are numbered once, in the scan whose result is written
    every = held(rows.mapInArrow(run, "id bigint, doc_id bigint, t bigint, same binary, fp bigint, cells array<bigint>, z binary"), "texts")
    classes = held(every.groupBy("same").agg(F.min(_order()).alias("low"), F.min("fp").alias("fp"), F.count("*").alias("times")), "same")
    single = every.join(classes.select(F.col("low.id").alias("id")), "id", "left_semi")
    gridded = held(single.select("id", F.explode("cells").alias("cell")), "grid")
    heads = gridded.groupBy("cell").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").select("cell", "head")
    shared = held(unsized(gridded).join(heads, "cell"), "shared")
    zipped = every.select("id", "z")
    stars = shared.where("head < id").select(F.col("id").alias("src"), F.col("head").alias("dst")).distinct()
    joined = _similar(held(stars, "stars"), zipped, shingle, least, held)
    if max_bits is not None:
        joined = held(joined.unionByName(_near_ids(classes, max_bits, held)), "linked")
    parts = held(connected_components(joined), "parts").withColumnRenamed("node", "id")
    placed = held(shared.join(parts, "id", "left").select("id", "cell", F.coalesce("component", "id").alias("part")), "placed")
    mixed = placed.groupBy("cell").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("cell")
    placed = held(unsized(placed).join(mixed, "cell"), "mixed")
    a, b = placed.alias("a"), unsized(placed).alias("b")
    rest = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.part") != F.col("b.part")))
    more = _similar(held(rest.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst")).distinct(), "rest"), zipped, shingle, least, held)
    reach = connected_components(joined.unionByName(more))
    grouped = classes.select("same", "low", "times", F.col("low.id").alias("node")).join(reach, "node", "left").select("same", "low", "times", F.coalesce("component", "node").alias("component"))
    best = grouped.groupBy("component").agg(F.min("low").alias("best"), F.sum("times").alias("rows")).where("rows > 1").select("component", "best")
    named = held(grouped.join(best, "component").select("same", "times", "best"), "named")
    found = join_counted(every.select("id", "doc_id", "t", "same"), named, ["same"], every.count())
    found = materialise(found.select("doc_id", "t", F.col("best.doc_id").alias("component_id"), (F.col("id") == F.col("best.id")).alias("first")), "groups")
    for path in spent:
        discard(docs.sparkSession, path)
    return found


def keep_first(docs: DataFrame, shingle: int = 5, least: float = 0.8, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without near copies: of each of :func:`similar_groups`, linked by fingerprints and by sets, the row of the smallest doc_id stays.

    Null and wordless texts aren't taken as copies of each other and stay. Rows with a null id go if their text is in a group with
    another row. Of rows equal in doc_id and text any one stays.
    """
    groups = similar_groups(docs, shingle, least, max_bits=max_bits)
    names = groups.groupBy("doc_id", "t").agg(F.max("first").alias("first"), F.count("*").alias("n"))
    names = materialise(names.where("n > 1 or not first"), "gone")  # written: a small one is then joined without moving texts
    kept = without(docs, names)
    again = names.where("first")
    if again.isEmpty():
        return kept
    repeated = docs.join(again, is_row(docs, again), "left_semi")
    return kept.unionByName(repeated.dropDuplicates(["doc_id", "text"]))
