"""Language identification: multinomial naive Bayes over hashed character n-grams.

A batch of texts is one sparse matrix of n-gram counts, scored by its product with the broadcast
matrix of log probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import rows_of, slices

GRAMS = (1, 2, 3)
BUCKETS = 1 << 14
#: Below this mean posterior, sharpened by text length alone up to a bound, a text has no clear language.
LEAST_SCORE = 0.5
UNKNOWN = "und"
#: Texts whose counts are held as one table at a time, and languages that a model can have.
ROWS, MOST_LANGUAGES = 32, 4096
_MIX = 0x9E3779B1


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Documents that training never sees: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def gram_counts(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts (text, bucket, n), by text and bucket, of lower-cased texts; runs of white space count once."""
    parts = [np.frombuffer(" ".join(["", *t.lower().split(), ""]).encode("utf-32-le", "replace"), "<u4") for t in texts]
    codes = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    counts = np.zeros(len(parts) * BUCKETS, np.int64)
    mixed = np.zeros(len(codes), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if n > len(codes):
            break
        mixed = (mixed[: len(codes) - n + 1] * np.uint32(_MIX)) ^ (codes[n - 1 :] + np.uint32(n))
        if n in GRAMS:
            spread = (mixed * np.uint32(0x85EBCA6B)) >> np.uint32(18)
            inside = owner[: len(mixed)] == owner[n - 1 :]
            counts += np.bincount((owner[: len(mixed)] * BUCKETS + spread)[inside], minlength=len(counts))
    at = np.flatnonzero(counts)
    return at // BUCKETS, at % BUCKETS, counts[at]


def _sized(texts: list[str], chars: int = 400_000) -> Iterator[list[int]]:
    """Runs of places of at most ``ROWS`` texts and about ``chars`` characters."""
    run, held = [], 0
    for i, text in enumerate(texts):
        if run and (len(run) == ROWS or held + len(text) > chars):
            yield run
            run, held = [], 0
        run.append(i)
        held += len(text)
    if run:
        yield run


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log probabilities by bucket and language) of all rows that may teach.

    Rows teach if their lang and text are not null and they aren't held out. What comes to the driver is
    one row of at most ``BUCKETS`` + 1 counts per language, summed by Spark. More than ``MOST_LANGUAGES`` values of lang
    are an error: they aren't languages, and their matrix isn't one to broadcast.
    """
    rows = rows_of(docs, "doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for run in _sized(texts):
                which, bucket, n = gram_counts([texts[i] for i in run])
                ends = np.searchsorted(which, np.arange(len(run) + 1))
                for k, i in enumerate(run):
                    row = sums.setdefault(langs[i], np.zeros(BUCKETS + 1, np.int64))
                    row[bucket[ends[k] : ends[k + 1]]] += n[ends[k] : ends[k + 1]]
                    row[BUCKETS] += 1
        for lang, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(row[at])], ["lang", "bucket", "n"])

    sums = rows.select("text", "lang").mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("grams")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not found:
        return [], np.zeros(0), np.zeros((BUCKETS, 0))
    table = np.zeros((BUCKETS + 1, len(found)))
    for k, row in enumerate(found):
        for bucket, n in row.grams:
            table[bucket, k] = n
    counts, docs_of = table[:BUCKETS] + 0.5, table[BUCKETS]
    return [r.lang for r in found], np.log(docs_of / docs_of.sum()), np.log(counts / counts.sum(axis=0))


def scores(texts: list[str | None], model: tuple[list[str], np.ndarray, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text; see :func:`predict`."""
    langs, priors, table = model
    names, values = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not langs:
        return names, values
    read = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    for run in _sized([texts[i] for i in read]):
        places = [read[i] for i in run]
        which, bucket, n = gram_counts([texts[i] for i in places])
        starts = np.searchsorted(which, np.arange(len(places)))
        sums = np.add.reduceat(table[bucket] * n[:, None], starts)
        many = np.add.reduceat(n, starts)[:, None]
        best = (sums + priors).argmax(axis=1)
        fair = priors + sums * (np.minimum(many, 100) / many)
        values[places] = 1 / np.exp(np.minimum(fair - np.take_along_axis(fair, best[:, None], axis=1), 700)).sum(axis=1)
        for i, k in zip(places, best.tolist(), strict=True):
            names[i] = langs[k]
    return names, np.clip(values, 0, 1)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row, from its text alone.

    ``und`` with score 0: null text, a text without a letter, or a model without languages. The
    score is the posterior of the language after at most 100 n-grams' worth of evidence: longer texts
    count with their mean, so that foreign or mixed text does not look certain by its length. Ties go to the first
    language by name. Repeated rows are each predicted.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, values = scores(batch.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(values)], ["doc_id", "held_out", "lang_pred", "score"]
            )

    rows = rows_of(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """Train on ``docs`` (doc_id, text, lang) and predict every row; see :func:`predict`."""
    return predict(docs, train(docs))


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without rows whose text has no letter, is null or has no clear language.

    Each row is judged by its own text where it is read, whatever its id: nothing is joined. Without
    any row to learn from all rows with a letter stay.
    """
    model = train(docs)
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, values = scores(batch.column("text").to_pylist(), shared.value)
            yield batch.filter(pa.array([name != UNKNOWN and value >= least for name, value in zip(names, values, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
