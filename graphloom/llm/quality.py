"""Document quality by a factorisation machine.

A text is a sparse vector: its hashed words, bins of statistics of its structure, and its
length as metadata. The score is a logistic of bias, weights and pairwise interactions of
low rank, summed in linear time: half of the squared sum minus the sum of squares, per factor.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import rows_of, slices
from graphloom.plans.scratch import materialise

WORD_BUCKETS = 1 << 16
BINS = 16
FACTORS = 8
#: Labelled documents that a model is fitted on at most, the smallest by hash of their id.
MOST_TRAINING = 8_000
THRESHOLD = 0.3
#: Statistics of a text, each turned into bins; see :func:`statistics`.
STATISTICS = 14
SIZE = WORD_BUCKETS + STATISTICS * BINS
_MARKS = re.compile(r"[^\w\s]")
_DOUBLED = re.compile(r"([^\w\s])\1")
_UPPER = re.compile(r"[A-Z]")
_DIGIT = re.compile(r"\d")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Documents that training never sees: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def statistics(text: str, n_chars: int | None, words: list[str], counts: Counter) -> list[float]:
    """Numbers from 0 to 1 on structure, spread so that equal bins tell texts apart."""
    chars, n = max(1, len(text)), max(1, len(words))
    lines = text.split("\n")
    marks = len(_MARKS.findall(text))
    top = counts.most_common(1)[0][1] if counts else 0
    once = sum(1 for c in counts.values() if c == 1)
    return [
        min(1.0, len(_UPPER.findall(text)) / chars),
        min(1.0, 4 * marks / chars),
        min(1.0, 8 * len(_DOUBLED.findall(text)) / n),
        min(1.0, 10 * len(_DIGIT.findall(text)) / chars),
        min(1.0, sum(map(len, words)) / n / 16),
        len(counts) / n,
        top / n,
        once / n,
        min(1.0, np.log1p(n_chars or len(text)) / 16),
        min(1.0, np.log1p(len(lines)) / 8),
        len(set(lines)) / len(lines),
        min(1.0, 4 * text.count("|") / n),
        sum(1 for a, b in zip(words, words[1:], strict=False) if a == b) / n,
        sum(1 for a, b in zip(words, words[2:], strict=False) if a == b) / n,
    ]


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        at = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 7) % WORD_BUCKETS
        if len(self) >= 500_000:
            self.clear()
        self[word] = at
        return at


def features(text: str | None, n_chars: int | None, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values); null is an empty text. Words weigh by the root of their share."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    at = np.fromiter(map(buckets.__getitem__, counts), np.int64, len(counts))
    value = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)) / max(1, len(words)))
    numbers = statistics(text, n_chars, words, counts)
    bins = [WORD_BUCKETS + k * BINS + min(BINS - 1, int(v * BINS)) for k, v in enumerate(numbers)]
    return np.concatenate([at, bins]), np.concatenate([value, np.full(len(bins), 0.5)])


class Machine:
    """Bias, weights and factors; everything is float64 numpy."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def margins(self, at: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of rows laid end to end, each with one feature at least."""
        linear = np.add.reduceat(self.weights[at] * value, starts)
        terms = self.factors[at] * value[:, None]
        sums, squares = np.add.reduceat(terms, starts), np.add.reduceat(terms * terms, starts)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1)

    @staticmethod
    def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 12, rate: float = 0.1, decay: float = 1e-4, batch: int = 64) -> Machine:
        """Adaptive gradient descent on the logistic loss, in a fixed order of batches."""
        if not rows:
            return Machine(0.0, np.zeros(SIZE), np.zeros((SIZE, FACTORS)))
        random = np.random.default_rng(11)
        machine = Machine(0.0, np.zeros(SIZE), random.normal(0, 0.02, (SIZE, FACTORS)))
        share = float(np.clip(labels.mean(), 0.01, 0.99))
        machine.bias = float(np.log(share / (1 - share)))
        seen_w, seen_v, seen_b = np.full(SIZE, 1e-4), np.full((SIZE, FACTORS), 1e-4), 1e-4
        for _ in range(rounds):
            order = random.permutation(len(rows))
            for begin in range(0, len(order), batch):
                pick = order[begin : begin + batch]
                sizes = np.array([len(rows[i][0]) for i in pick])
                at, value = (np.concatenate([rows[i][k] for i in pick]) for k in (0, 1))
                starts = np.cumsum(sizes) - sizes
                terms = machine.factors[at] * value[:, None]
                sums = np.add.reduceat(terms, starts)
                slope = 1 / (1 + np.exp(-machine.margins(at, value, starts))) - labels[pick]
                each = np.repeat(slope / len(pick), sizes)
                used, inverse = np.unique(at, return_inverse=True)
                grad_w = np.bincount(inverse, each * value) + decay * machine.weights[used]
                pulls = (np.repeat(sums, sizes, axis=0) - terms) * (each * value)[:, None]
                grad_v = np.stack([np.bincount(inverse, pulls[:, f]) for f in range(FACTORS)], axis=1) + decay * machine.factors[used]
                grad_b = slope.mean()
                seen_w[used] += grad_w**2
                seen_v[used] += grad_v**2
                seen_b += grad_b**2
                machine.weights[used] -= rate * grad_w / np.sqrt(seen_w[used])
                machine.factors[used] -= 0.3 * rate * grad_v / np.sqrt(seen_v[used])
                machine.bias -= rate * grad_b / np.sqrt(seen_b)
        return machine


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> Machine:
    """Fit on labelled rows that aren't held out, ``most`` of them at most, one of each id.

    The bound caps what reaches the driver, about ``most`` times a text's distinct words. Of rows that share an id the least in its features
    teaches; rows with a null label or id don't; without any the score is one half.
    """
    chosen = (
        labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .select("doc_id", F.col("quality").cast("double").alias("label"))
        .dropDuplicates(["doc_id"])
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in slices(batches):
            rows = [features(t, n, buckets) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32()))],
                ["doc_id", "label", "at", "value"],
            )

    rows = rows_of(docs, "doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id")  # at most ``most`` ids
    every = materialise(rows.mapInArrow(run, "doc_id bigint, label double, at array<int>, value array<float>"), "features")
    found = every.groupBy("doc_id").agg(F.min(F.struct("label", "at", "value")).alias("row")).select("doc_id", "row.*").toPandas()
    found = found.sort_values("doc_id", kind="stable")
    pairs = [(np.asarray(a, np.int64), np.asarray(v, np.float64)) for a, v in zip(found["at"], found["value"], strict=True)]
    return Machine.fit(pairs, found["label"].to_numpy())


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; null and empty texts score by their statistics."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, buckets = shared.value, _Buckets()
        for batch in slices(batches):
            rows = [features(t, n, buckets) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist(), strict=True)]
            sizes = np.array([len(r[0]) for r in rows])
            margins = machine.margins(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.cumsum(sizes) - sizes)
            values = 1 / (1 + np.exp(-np.clip(margins, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(values), pa.array((values >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = rows_of(docs, "doc_id", "text", "n_chars").withColumn("held_out", held_out())
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def quality_classifier(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on ``labels`` (doc_id, quality) and score every row of ``docs``; see :func:`train`, :func:`score`."""
    return score(docs, train(docs, labels, most), threshold)
