"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions alone.

Lines are sequences of words and an edit replaces, drops or adds one word. Deleting one word gives
a line's variants. Two lines are one replacement apart if they share a variant with the same word place deleted, and
one drop or insertion apart if a variant of one is the other, so joining hashed variants finds all of them, and
the earliest line of each group stands for the group: no pairs arise.

Variants are emitted for few lines only. One edit leaves the first or the last half of a line as it is, so a line
that shares neither half with a different line has no neighbour. Halves are hashed in the first scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import is_row, rows_of, text_key
from graphloom.plans.scratch import discard, materialise, materialise_at
from graphloom.plans.spread import unsized

#: Words from which equal lines count in the query, and from which an edit leaves a similarity of 0.8.
LEAST_EQUAL, LEAST_NEAR = 3, 5


def _uneven(text: Column) -> Column:
    """Whether any line isn't words joined by single blanks."""
    found = text.startswith(" ") | text.endswith(" ")
    for mark in ("  ", " \n", "\n ", "\t", "\r", "\x0b", "\x0c"):
        found = found | text.contains(mark)
    return found


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))


def _halves(line: Column, m: Column) -> Column:
    """Hashed halves by which a line of m words meets those as long and those one word longer or shorter."""
    low, short = F.floor(m / 2).cast("int"), F.floor((m - 1) / 2).cast("int")
    half = lambda tag, words: F.xxhash64(F.lit(tag), F.call_function("substring_index", line, F.lit(" "), words))
    return F.array_distinct(F.array(half("first", low), half("first", short), half("last", low - m), half("last", short + 1 - m)))


def _place(*names: str) -> Column:
    """Order of lines: null ids first, then by doc_id, hash of the text and line."""
    return F.struct(F.col("doc_id").isNotNull().alias("known"), *[F.col(n) for n in names])


def _neighbours(docs: DataFrame, lines: DataFrame, held) -> DataFrame:
    """(h, g): distinct lines that an earlier line is one word edit away from; ``held`` writes what lasts until they are known."""
    keyed = lines.where(F.size("halves") > 0).select("h", "g", F.explode("halves").alias("half"))
    shared = keyed.groupBy("half").agg(F.count("*").alias("lines")).where("lines > 1").select("half")
    chosen = unsized(keyed).join(shared, "half").select("h", "g").distinct()
    wanted = held(
        unsized(lines).join(chosen, ["h", "g"])
        .groupBy("first.doc_id", "first.t")
        .agg(F.collect_list(F.struct("first.n", "h", "g", "first")).alias("wanted")),
        "wanted",
    )
    d, w = docs.alias("d"), wanted.alias("w")
    texts = d.join(w, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.t") == F.col("w.t")))
    picked = held(
        texts.select(F.split("d.text", "\n").alias("all"), F.explode("w.wanted").alias("l"))
        .select("l.h", "l.g", "l.first", F.split(_normal(F.col("all")[F.col("l.n")]), " ").alias("words"))
        .dropDuplicates(["h", "g"]),
        "lines",
    )
    # a line's hash is the exclusive or of its words' hashes by place, and deleting word i moves the later ones down:
    # the variant is the exclusive or of a[j] for j < i and b[j] for j > i, where b holds the places moved down
    words = picked.select("h", "g", F.posexplode("words").alias("i", "w"))
    a, b = F.xxhash64("w", "i"), F.xxhash64("w", F.col("i") - 1)
    line = Window.partitionBy("h", "g")
    before = F.coalesce(F.bit_xor(F.col("a").bitwiseXOR(F.col("b"))).over(line.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    variants = held(
        words.select("h", "g", "i", a.alias("a"), b.alias("b")).select(
            "h", "g", "i",
            before.bitwiseXOR(F.col("b")).bitwiseXOR(F.bit_xor("b").over(line)).alias("v"),
            F.when(F.col("i") == 0, F.bit_xor("a").over(line)).alias("self"),
        ),
        "variants",
    )
    # whole lines stand among the variants as place -1; only hashes that occur again can join anything
    hashed = variants.select("v", "i", "h", "g").unionByName(variants.where("i = 0").select(F.col("self").alias("v"), F.lit(-1).alias("i"), "h", "g"))
    again = hashed.groupBy("v").agg(F.count("*").alias("lines")).where("lines > 1").select("v")
    shared = held(unsized(hashed).join(again, "v").join(unsized(picked.select("h", "g", "first")), ["h", "g"]), "shared")
    line = F.struct("first", "h", "g")
    cut, whole = shared.where("i >= 0"), shared.where("i < 0").select("v", line.alias("whole"))
    heads = cut.groupBy("v", "i").agg(F.min(line).alias("other"), F.count("*").alias("lines")).where("lines > 1")
    replaced = unsized(cut).join(heads, ["v", "i"]).where("other.first < first").select("h", "g", "other", F.col("i").alias("mine"), F.col("i").alias("theirs"))
    met = unsized(cut).join(unsized(whole), "v").select(line.alias("longer"), "whole", "i")
    longer = met.where("whole.first < longer.first").select("longer.h", "longer.g", F.col("whole").alias("other"), F.col("i").alias("mine"), F.lit(-1).alias("theirs"))
    shorter = met.where("longer.first < whole.first").select("whole.h", "whole.g", F.col("longer").alias("other"), F.lit(-1).alias("mine"), F.col("i").alias("theirs"))
    found = replaced.unionByName(longer).unionByName(shorter)
    best = found.groupBy("h", "g").agg(F.min(F.struct("other", "mine", "theirs")).alias("best")).select("h", "g", F.col("best.other.h").alias("oh"), F.col("best.other.g").alias("og"), "best.mine", "best.theirs")
    # exact check of the edit: what is left of both lines must be the same words
    left = lambda words, i: F.when(i < 0, words).otherwise(F.concat(F.slice(words, F.lit(1), i), F.slice(words, i + 2, F.size(words))))
    mine = picked.select("h", "g", F.col("words").alias("my_words"))
    theirs = picked.select(F.col("h").alias("oh"), F.col("g").alias("og"), F.col("words").alias("their_words"))
    checked = best.join(unsized(mine), ["h", "g"]).join(unsized(theirs), ["oh", "og"])
    return checked.where(left(F.col("my_words"), F.col("mine")) == left(F.col("their_words"), F.col("theirs"))).select("h", "g")


def removed_lines(docs: DataFrame, least_equal: int = LEAST_EQUAL) -> DataFrame:
    """(doc_id, t, n_lines, removed): per document of ``docs`` the places of lines that occur earlier.

    A line goes if an equal line of at least ``least_equal`` words, or one of at least five words at one word edit or less, occurs earlier in the
    table: in a smaller doc_id or higher up in the same document; lines are judged on the input. White space inside a line
    doesn't tell lines apart, and lines of fewer words always stay, with 1 the empty ones alone. Null text is one empty line. Rows
    equal in doc_id and text are one document; null ids come first.
    """
    rows = rows_of(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("t", text_key("text"))
    documents = rows.select("doc_id", "t", F.size(F.split("text", "\n")).alias("n_lines"))
    marked = rows.withColumn("uneven", _uneven(F.col("text")))  # below the explosion: once per text
    each = marked.select("doc_id", "t", "uneven", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    each = each.select("doc_id", "t", "n", F.when(F.col("uneven"), _normal(F.col("line"))).otherwise(F.col("line")).alias("line"))
    m = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + F.when(F.col("line") == "", 0).otherwise(1)
    # short lines go after the write: a filter before it would count the words twice
    flat = materialise(
        each.select(
            "doc_id", "t", "n", m.alias("m"), F.xxhash64("line").alias("h"), F.hash("line").alias("g"),
            F.when(m >= LEAST_NEAR, _halves(F.col("line"), m)).otherwise(F.array().cast("array<bigint>")).alias("halves"),
        ),
        "scanned",
    ).where(F.col("m") >= least_equal)
    spent: list[str] = []

    def held(df: DataFrame, tag: str) -> DataFrame:
        table, path = materialise_at(df, tag)
        spent.append(path)
        return table

    lines = held(
        flat.groupBy("h", "g").agg(F.min(_place("doc_id", "t", "n")).alias("first"), F.count("*").alias("times"), F.first("halves").alias("halves")), "distinct"
    )
    near = _neighbours(rows, lines, held).withColumn("near", F.lit(True))
    flagged = lines.select("h", "g", "first", "times").join(near, ["h", "g"], "left").where("near or times > 1").select("h", "g", "first", F.coalesce("near", F.lit(False)).alias("near"))
    flagged = materialise(flagged, "flagged")
    for path in spent:
        discard(docs.sparkSession, path)
    gone = (
        flat.select("doc_id", "t", "n", "h", "g")
        .join(flagged, ["h", "g"])
        .where(F.col("near") | ~_place("doc_id", "t", "n").eqNullSafe(F.col("first")))
        .groupBy("doc_id", "t")
        .agg(F.array_sort(F.collect_set("n")).alias("removed"))
    )
    s, g = documents.alias("s"), gone.alias("g")
    return s.join(g, F.col("s.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("s.t") == F.col("g.t")), "left").select(
        "s.doc_id", "s.t", "s.n_lines", F.coalesce("g.removed", F.array().cast("array<int>")).alias("removed")
    )


def line_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) of each row; ``removed`` joins line numbers from 0 by commas."""
    return removed_lines(docs).select(
        "doc_id",
        F.col("n_lines").cast("bigint").alias("n_lines"),
        F.size("removed").cast("bigint").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed lines cut out of text; rows of which nothing but white space is left go.

    Equal lines count at any length: one of a script without blanks, a link or encoded data is a single word.
    Rows that lose nothing stay as they are, whatever they hold. n_chars, where it exists, follows the text.
    """
    found = materialise(removed_lines(docs, least_equal=1).where(F.size("removed") > 0).select("doc_id", "t", F.col("removed").alias("_removed")).distinct(), "gone")
    joined = docs.join(found, is_row(docs, found), "left")
    gone = found["_removed"]
    lines = F.filter(F.transform(F.split(docs["text"], "\n"), lambda x, n: F.struct(x.alias("x"), n.alias("n"))), lambda s: ~F.array_contains(gone, s["n"]))
    text = F.when(gone.isNull(), docs["text"]).otherwise(F.array_join(F.transform(lines, lambda s: s["x"]), "\n"))
    put = {"text": text, "n_chars": F.when(gone.isNull(), docs["n_chars"]).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": text}
    kept = joined.where(gone.isNull() | text.rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*[put[c].alias(c) if c in put else docs[c] for c in docs.columns])
