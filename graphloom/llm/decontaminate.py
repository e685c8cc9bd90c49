"""Benchmark decontamination by greedy string tiling.

Seeds, runs of five tokens that a document shares with a benchmark item, choose the pairs whose
shared seeds could cover enough of the item. For those, running Karp-Rabin marks the longest common
runs that don't overlap, again and again; the share of the item under tiles is its coverage. Tiles
lie anywhere in the document, so an item whose parts come in another order is found as well.

Documents are read and tokenized once. A bitmap of the benchmark's seeds, of bounded size whatever the
benchmark's, leaves of each text the words in seeds that some item may have; everything else is joined by
shuffles: seeds to seeds, pairs to texts and items. No part of either table passes through the driver.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import rows_of, slices, text_key, without
from graphloom.llm.rolling import Sums, Texts, WordHash
from graphloom.plans.scratch import discard, materialise, materialise_at
from graphloom.plans.spread import unsized

SEED = 5
COVERAGE = 0.8
#: Bits of the bitmap of seeds at most: 16 MB.
MOST_BITS = 1 << 27
_BUCKET = 1 << 15  # bits of one of Spark's bitmaps
# Runs of word characters; of scripts that are written without blanks each character is a token.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
_TOKEN = re.compile(rf"[{_ALONE}]|[^\W{_ALONE}]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def _free_runs(free: np.ndarray) -> np.ndarray:
    """How many places are free from each place on."""
    at = np.arange(len(free))
    ends = np.minimum.accumulate(np.where(free, len(free), at)[::-1])[::-1]
    return ends - at


def greedy_tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(item place, text place, length) of tiles of at least ``least`` words (hashes), longest first.

    Words of 0 match nothing. Ties go to the earlier place in the item, then in the text. Runs of the search
    length are compared by rolling hashes; that length starts at 20, grows to a far longer match, and halves
    down to ``least``. What a tile leaves of a longer match goes back among the matches, so that the order is that of
    always taking the longest run left.
    """
    free_item, free_text = item != 0, text != 0
    in_item, in_text = Sums(item).runs, Sums(text).runs
    tiles: list[tuple[int, int, int]] = []

    def matches(length: int) -> list[tuple[int, int, int]]:
        """All common runs of at least ``length`` free words that can't be longer, as (-length, item place, text place)."""
        run_item, run_text = _free_runs(free_item), _free_runs(free_text)
        mine, theirs = np.flatnonzero(run_item >= length), np.flatnonzero(run_text >= length)
        if not len(mine) or not len(theirs):
            return []
        keys = in_item(mine, mine + length)
        order = np.argsort(keys, kind="stable")
        mine, keys = mine[order], keys[order]
        hashes = in_text(theirs, theirs + length)
        low, high = np.searchsorted(keys, hashes, "left"), np.searchsorted(keys, hashes, "right")
        ends = np.cumsum(high - low)
        found, begin = [], 0
        while begin < len(theirs):  # a million pairs of places at a time
            base = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, base + 1_000_000, "right")))
            sizes = (high - low)[begin:stop]
            j = np.repeat(theirs[begin:stop], sizes)
            i = mine[np.repeat(low[begin:stop], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
            begin = stop
            inner = (i > 0) & (j > 0)
            inner[inner] = free_item[i[inner] - 1] & free_text[j[inner] - 1] & (item[i[inner] - 1] == text[j[inner] - 1])
            i, j = i[~inner], j[~inner]  # others are part of a match that begins before
            sure, most = np.full(len(i), length), np.minimum(run_item[i], run_text[j])
            while (sure < most).any():  # the longest equal run, by halving
                tried = (sure + most + 1) // 2
                equal = in_item(i, i + tried) == in_text(j, j + tried)
                sure, most = np.where(equal, tried, sure), np.where(equal, most, tried - 1)
            found += zip((-sure).tolist(), i.tolist(), j.tolist(), strict=True)
        return found

    length = max(least, min(20, len(item), len(text)))
    while free_item.any():
        found = matches(length)
        longest = -min(found)[0] if found else 0
        if longest > 2 * length:
            length = longest
            continue
        heapq.heapify(found)
        while found and free_item.any():
            k, i, j = heapq.heappop(found)
            k = -k
            open_ = free_item[i : i + k] & free_text[j : j + k] & (item[i : i + k] == text[j : j + k])
            if open_.all():
                tiles.append((i, j, k))
                free_item[i : i + k] = free_text[j : j + k] = False
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a >= length:
                    heapq.heappush(found, (a - b, i + a, j + a))
        if length == least:
            break
        length = max(least, length // 2)
    return tiles


def coverage(item: np.ndarray, text: np.ndarray, seed: int, least: float) -> float:
    """Share of the item under tiles; 0 where the seeds that it shares can't cover ``least`` of it."""
    starts = np.arange(len(item) - seed + 1)
    if not len(starts) or len(text) < seed:
        return 0.0
    at = np.arange(len(text) - seed + 1)
    shared = np.isin(Sums(item).runs(starts, starts + seed), Sums(text).runs(at, at + seed))
    edge = np.zeros(len(item) + 1, np.int64)
    np.add.at(edge, starts[shared], 1)
    np.add.at(edge, starts[shared] + seed, -1)
    if (np.cumsum(edge[:-1]) > 0).sum() < least * len(item):
        return 0.0
    return sum(k for _, _, k in greedy_tiles(item, text, seed)) / len(item)


def _items(benchmark: DataFrame, seed: int) -> DataFrame:
    """(item, item_id, words, n, seeds): distinct items as word hashes, with the hashes of their seeds by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in slices(batches):
            texts = Texts(batch.column("text").to_pylist(), tokens, hashes)
            starts, text = texts.windows(seed)
            seeds = texts.runs(starts, starts + seed).view(np.int64)
            cuts = np.searchsorted(text, np.arange(len(texts.counts) + 1))
            words = [texts.words[b : b + n].astype("<u8").tobytes() for b, n in zip(texts.begins, texts.counts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(words, pa.binary()), pa.array(texts.counts), pa.array([seeds[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.list_(pa.int64()))],
                ["item_id", "words", "n", "seeds"],
            )

    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    known = rows.mapInArrow(run, "item_id bigint, words binary, n bigint, seeds array<bigint>").where(F.col("n") >= seed).dropDuplicates(["item_id", "words"])
    return known.select(F.monotonically_increasing_id().alias("item"), "item_id", "words", "n", "seeds")


def _bitmap(seeds: DataFrame, most: int) -> np.ndarray:
    """Bits of the hashes modulo their number, which is a power of two up to ``most``."""
    count = seeds.agg(F.approx_count_distinct("seed")).first()[0]
    bits = min(most, max(_BUCKET, 1 << math.ceil(math.log2(16 * count + 1))))
    place = (F.col("seed").bitwiseAND(F.lit(bits - 1)) + 1).cast("bigint")
    parts = seeds.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    held = np.zeros(bits // 8, np.uint8)
    for row in parts.toLocalIterator():  # at most ``most`` bits in all
        held[(row.bucket - 1) * _BUCKET // 8 :][: _BUCKET // 8] = np.frombuffer(row.bits, np.uint8)
    return held


def _scan(docs: DataFrame, bitmap: np.ndarray, seed: int) -> DataFrame:
    """(row, doc_id, t, seeds, words) of each row: hashes of seeds that some item may have, and the words in them, runs apart by 0."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # at most MOST_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hashes = shared.value, WordHash()
        mask = np.uint64(8 * len(bitmap) - 1)
        for batch in slices(batches):
            texts = Texts(batch.column("text").to_pylist(), tokens, hashes)
            starts, text = texts.windows(seed)
            found = texts.runs(starts, starts + seed)
            place = found & mask
            hit = (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            starts, text, found = starts[hit], text[hit], found[hit].view(np.int64)
            edge = np.zeros(len(texts.words) + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + seed, -1)
            inside = np.cumsum(edge[:-1]) > 0
            cuts = np.searchsorted(text, np.arange(len(texts.counts) + 1))
            seeds, words = [], []
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if a == b:
                    seeds.append([])
                    words.append(None)
                    continue
                span = slice(texts.begins[k], texts.begins[k] + texts.counts[k])
                mine = inside[span]
                reduced = np.where(mine, texts.words[span], 0)
                seeds.append(np.unique(found[a:b]))
                words.append(reduced[mine | np.concatenate([[False], mine[:-1]])].astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("t"), pa.array(seeds, pa.list_(pa.int64())), pa.array(words, pa.binary())],
                ["row", "doc_id", "t", "seeds", "words"],
            )

    rows = rows_of(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", text_key("text").alias("t"), "text")
    return rows.mapInArrow(run, "row bigint, doc_id bigint, t bigint, seeds array<bigint>, words binary")


def _candidates(scanned: DataFrame, items: DataFrame, seed: int, least: float) -> DataFrame:
    """(row, item) that share enough seeds for a coverage of ``least``.

    Tiles of at least ``seed`` words that cover so much of an item of n words hold ``least`` * n / ``seed`` of its seeds or more. The
    commonest seeds of the benchmark, half that many of each item, are left out and the rest asked for: formulas that
    most items begin with don't pair all of them with every text that has them.
    """
    places = items.select("item", "n", F.posexplode("seeds").alias("place", "seed"))
    common = places.groupBy("seed").agg(F.count("*").alias("times"))
    needed = F.ceil(F.col("n") * least / seed - 1e-9)
    ranked = places.join(common, "seed").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("times"), "place")))
    kept = ranked.where(F.col("rank") > F.floor(needed / 2)).select("item", "seed", (needed - F.floor(needed / 2)).alias("wanted"))
    hits = scanned.where(F.size("seeds") > 0).select("row", F.explode("seeds").alias("seed"))
    met = unsized(hits).join(kept, "seed").groupBy("row", "item").agg(F.count("*").alias("shared"), F.first("wanted").alias("wanted"))
    return met.where("shared >= wanted").select("row", "item")


def _covered(docs: DataFrame, benchmark: DataFrame, seed: int, least: float, most_bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, t) of ``docs``, and (row, items, coverage) of those that hold items."""
    spent: list[str] = []

    def held(df: DataFrame, tag: str) -> DataFrame:
        table, path = materialise_at(df, tag)
        spent.append(path)
        return table

    items = held(_items(benchmark, seed), "items")
    bitmap = _bitmap(items.select(F.explode("seeds").alias("seed")), most_bits)
    scanned = held(_scan(docs, bitmap, seed), "seeds")
    pairs = _candidates(scanned, items, seed, least)
    both = pairs.join(items.select("item", "item_id", F.col("words").alias("item_words")), "item").join(scanned.select("row", "words"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("item_words", "words"))
            shares = [coverage(np.frombuffer(i, "<u8"), np.frombuffer(w, "<u8"), seed, least) for i, w in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("item_id"), pa.array(shares, pa.float64())], ["row", "item_id", "share"])

    shares = both.select("row", "item_id", "item_words", "words").mapInArrow(run, "row bigint, item_id bigint, share double").where(F.col("share") >= least)
    found = materialise(shares.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("share").alias("coverage")), "covered")
    rows = materialise(scanned.select("row", "doc_id", "t"), "rows")
    for path in spent:
        discard(docs.sparkSession, path)
    return rows, found


def contamination(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, least: float = COVERAGE, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, n_items, item_ids, max_coverage, contaminated) of each row of ``docs`` (doc_id, text).

    ``item_ids`` are the benchmark items (item_id, text) of which at least ``least`` of the tokens lie under tiles
    of at least ``seed`` tokens, ascending and comma-joined. Tokens are lower-cased runs of word characters, and single
    characters of scripts without blanks; they are compared by 64-bit hashes. Null
    and empty texts hold nothing; items with fewer than ``seed`` tokens, a null text or a null id can't be found, rows that
    repeat an item count once, and an id with several texts is found by any. A benchmark too large for a bitmap of
    ``most_bits`` only makes it choose less: candidates are joined by their seeds all the same.
    """
    rows, found = _covered(docs, benchmark, seed, least, most_bits)
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    return rows.join(found, "row", "left").select(
        "doc_id",
        F.size(items).alias("n_items"),
        F.array_join(items.cast("array<string>"), ",").alias("item_ids"),
        F.coalesce("coverage", F.lit(0.0)).alias("max_coverage"),
        (F.size(items) > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the texts that hold a benchmark item, whatever their id; other texts with the same id stay."""
    rows, found = _covered(docs, benchmark, **{"seed": SEED, "least": COVERAGE, "most_bits": MOST_BITS, **how})
    gone = materialise(rows.join(found, "row", "left_semi").select("doc_id", "t").distinct(), "gone")  # written: a small one is then joined without moving texts
    return without(docs, gone)
