"""Spelling variants grouped by asymmetric q-chunks.

Two words one edit apart: the one that is no longer contributes two disjoint chunks, its halves, the other its positional grams
of the same sizes. The edit spoils one chunk at most, so the other is a gram of the longer word, at its own place or, after an
insertion, one further on: words are joined on chunk and place within a shift of one. Grams at places that no chunk can
meet are never emitted. A chunk of a few letters is shared by very many words, so the half that may hold the edit is cut into
chunks and grams once more: a key then fixes three quarters of a word, and the rows of a key stay few however large the vocabulary. What
meets is verified by its edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import rows_of
from graphloom.plans.scratch import discard, materialise_at

#: Code points and occurrences from which a run of letters is a word; how many times more frequent a form must be.
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 7, 2, 10
#: One in so many occurrences loses a code point before words are counted.
SPOILED = 31

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(docs: DataFrame) -> DataFrame:
    """(word, n): distinct runs of letters and how often they occur; runs that are too short for a word don't leave the scan."""
    rows = rows_of(docs, "doc_id", "text").where("text is not null")
    runs = F.regexp_extract_all("text", F.lit(f"([A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}})"), F.lit(1))
    run = rows.select("doc_id", F.explode(runs).alias("run")).select("doc_id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    crc = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    hit = run.select("run", crc.alias("crc"))
    at = (F.col("crc") % F.length("run")).cast("int")
    word = F.when(F.col("crc") % SPOILED == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return hit.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


def _keys(word: Column, length: Column, shift: int) -> Column:
    """Hashed keys of ``word``, once for each of two chunks of each of two halves.

    ``length`` is that of the word that contributes chunks. With ``shift`` 0 these are its chunks and the grams of words as long; with 1
    the grams of words one longer, where what stands behind the edit is one place further on. A key holds both chunks and their places.
    """
    whole = length + shift
    half = F.floor(length / 2).cast("int")
    rest = length - half
    out = []
    # the part that may hold the edit, from place `low` on, is cut where the chunk side cuts it
    for tag, low, size, chunk in (("last", half, rest, F.substring(word, F.lit(1), half)), ("first", F.lit(0), half, F.substring(word, whole - rest + 1, rest))):
        cut = F.floor(size / 2).cast("int")
        before = F.substring(word, low + 1, cut)
        after = F.substring(word, low + 1 + cut + shift, size - cut)
        out += [F.xxhash64(F.lit(f"{tag} before"), length, chunk, before), F.xxhash64(F.lit(f"{tag} after"), length, chunk, after)]
    return F.array(*out)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, b): pairs of distinct words of ``vocabulary`` (word once each) one inserted, deleted or replaced code point apart, each pair once, a the shorter or earlier."""
    sized = vocabulary.select("word", F.length("word").alias("m"))
    m = F.col("m")
    chunks = sized.select(F.col("word").alias("a"), m.alias("length"), F.explode(F.array_distinct(_keys(F.col("word"), m, 0))).alias("key"))
    equal = sized.select(F.col("word").alias("b"), m.alias("length"), F.explode(F.array_distinct(_keys(F.col("word"), m, 0))).alias("key"))
    longer = sized.select(F.col("word").alias("b"), (m - 1).alias("length"), F.explode(F.array_distinct(_keys(F.col("word"), m - 1, 1))).alias("key"))
    grams = equal.unionByName(longer)
    met = chunks.join(grams, ["key", "length"]).where((F.length("b") > F.col("length")) | (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


def _roots(forms: DataFrame, spent: list[str]) -> DataFrame:
    """(word, root) from (word, form), forms being ever more frequent: pointers are doubled until none moves."""
    now, path = materialise_at(forms.select("word", F.col("form").alias("root")), "roots")
    spent.append(path)
    while True:
        step = now.alias("x").join(now.alias("y"), F.col("x.root") == F.col("y.word"), "left")
        after, path = materialise_at(step.select("x.word", F.coalesce("y.root", "x.root").alias("root"), F.col("y.root").isNotNull().alias("moved")), "roots")
        spent.append(path)
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of at least 7 letters that occurs at least twice.

    Words are maximal runs of Latin letters, lower-cased in A-Z only; one occurrence in 31, told by a hash of document and word, loses
    a letter first. The form is the commonest near word (ties: the first in code-point order) if it is ten times as frequent, else null; the root
    ends the chain of forms. Null and empty texts have no words; a null doc_id counts as an empty one. Repeated rows count each time; an empty table has no words.
    """
    spent: list[str] = []

    def held(df: DataFrame, tag: str) -> DataFrame:
        table, path = materialise_at(df, tag)
        spent.append(path)
        return table

    counted, _ = materialise_at(words(docs), "words")
    pairs = held(near_pairs(counted), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(counted.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b").groupBy("a").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("least"), F.col("b").alias("word"))).alias("best")
    )
    often = -F.col("best.least")
    takes = often >= FORM_RATIO * F.col("n")
    formed, _ = materialise_at(
        counted.join(near.withColumnRenamed("a", "word"), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(takes, F.col("best.word")).alias("form"), F.when(takes, often).alias("form_n")
        ),
        "forms",
    )
    roots, _ = materialise_at(_roots(formed.where("form is not null"), spent), "variants")
    for path in spent:
        discard(docs.sparkSession, path)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
