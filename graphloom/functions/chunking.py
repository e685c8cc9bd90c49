"""Splitting documents into chunks: preparing, splitting, offsets, vectors as text."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators from the strongest, sizes in characters.
SEPARATORS = (". ", "! ", "? ", "\n\n", "\n", "; ", ", ", " ", "")
SIZE, OVERLAP, LEAST, MOST = 900, 150, 100, 1100


def prepare(text: Column | str) -> Column:
    """Byte order mark and carriage returns off, page numbers and contents lines out, broken sentences joined; doing it again changes nothing."""
    c = F.col(text) if isinstance(text, str) else text
    for pattern, by in (
        ("^\\x{FEFF}+", ""), ("\r\n?", "\n"), (r"(?m)^[ \t]*(?:[Pp]age )?[0-9]{1,4}(?: of [0-9]+)?[ \t]*$", ""), (r"(?m)^.*\.{5,} *[0-9]+ *$", ""),
        (r"(\p{Ll}),?\n(\p{Ll})", "$1 $2"), ("\n{3,}", "\n\n"),
    ):
        c = F.regexp_replace(c, pattern, by)
    return c


# Lines that are no text of a document: page numbers, marks of structure, and the kinds of lines of a table of contents.
PAGE_NUMBER = r"(?m)^[ \t]*(?:-+[ \t]*)?[0-9]{1,4}(?:[ \t]*-+)?[ \t]*$"
STRUCTURE = r"(?m)^[ \t]*(?:CHAPTER|BOOK|PART|SECTION|VOLUME)[ \t]+(?:[IVXLCDM]+|[0-9]+)[.:]?[ \t]*$"
CONTENTS = r"(?m)(?:^[ \t]*(?:[^\n]*\.{4,}[ \t]*[0-9]+|[IVXLCDM]+\.[ \t]+[^\n]+|[0-9]+(?:\.[0-9]+)+[ \t]+[^\n]+)[ \t]*(?:\n|$)){3,}"
PAGE_HEAD = r"(?:^|\n\n)[0-9]{1,4} [A-Z][A-Za-z ]{2,40}(?:\n\n|$)"
PAGE_BREAK = r"\f|\n{3,}"
#: Pages on which a line must stand to be a running head.
REPEATED = 3


def _lines_cleaned(text: Column) -> Column:
    """Line ends and byte order marks made one, page numbers, structure and contents taken out, three newlines made two."""
    c = F.regexp_replace(F.regexp_replace(text, "^\\x{FEFF}+", ""), "\r\n?", "\n")
    for pattern in (PAGE_NUMBER, STRUCTURE, CONTENTS):
        c = F.regexp_replace(c, pattern, "")
    return F.regexp_replace(F.replace(c, F.lit("\f"), F.lit("\n\n")), r"\n{3,}", "\n\n")


def _flowing(text: Column) -> Column:
    """Paragraphs that are heads of pages out, sentences broken by a paragraph joined, line wraps and runs of blanks to one blank."""
    c = F.regexp_replace(text, PAGE_HEAD, "\n\n")
    c = F.regexp_replace(c, r"([\p{Ll}]),?\n\n([\p{Ll}])", "$1 $2")
    c = F.regexp_replace(F.replace(c, F.lit("\n\n"), F.lit("\u0001")), r"[ \t]*\n[ \t]*", " ")
    return F.trim(F.regexp_replace(F.replace(c, F.lit("\u0001"), F.lit("\n\n")), "[ \t]{2,}", " "))


def without_running_heads(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (doc_id, text) without the lines that stand alike on ``REPEATED`` or more pages of their document; pages end at form feeds or three newlines.

    Lines are counted over pages by a group of document and line; what is found, a document's few running heads, comes back to it in one row.
    """
    pages = docs.select("doc_id", F.posexplode(F.split(F.coalesce(text, F.lit("")), PAGE_BREAK)).alias("page", "body"))
    lines = pages.select("doc_id", "page", F.explode(F.array_distinct(F.transform(F.split("body", "\n"), lambda x: F.trim(x)))).alias("line")).where("line <> ''")
    heads = lines.groupBy("doc_id", "line").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATED).groupBy("doc_id").agg(F.collect_list("line").alias("_heads"))
    met = docs.join(heads, "doc_id", "left")
    # a line is kept with the page break before it
    kept = F.filter(F.split(F.regexp_replace(text, "\f", "\f\n"), "\n"), lambda x: ~F.array_contains("_heads", F.trim(x)))
    return met.withColumn(text, F.when(F.col("_heads").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("_heads")


def preprocessed(docs: DataFrame, text: str = "text", noise: bool = True, flow: bool = True) -> DataFrame:
    """Texts made ready for splitting: always one kind of line end and no byte order mark; with ``noise`` no running heads, page numbers, marks of structure and contents; with ``flow`` no line wraps."""
    if not noise:
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "^\\x{FEFF}+", ""), "\r\n?", "\n"), r"\n{3,}", "\n\n")
        return docs.withColumn(text, _flowing(plain) if flow else plain)
    out = without_running_heads(docs.withColumn(text, F.regexp_replace(text, "\r\n?", "\n")), text)
    clean = _lines_cleaned(F.col(text))
    return out.withColumn(text, _flowing(clean) if flow else clean)


# What ends a sentence, and the characters that stand for it inside quotation marks.
_ENDS, _SHIELDS = ".!?", "\u2024\u2757\u2753"
_QUOTE = "\"[^\"\\n]*\"|\u201c[^\u201d\\n]*\u201d"


def protect_quotes(text: Column | str) -> Column:
    """Ends of sentences inside quotation marks as other characters, one for one, so that nothing is cut there and places stay."""
    c = F.col(text) if isinstance(text, str) else text
    around, quotes = F.split(c, _QUOTE), F.regexp_extract_all(c, F.lit(f"({_QUOTE})"), F.lit(1))
    held = F.transform(quotes, lambda q: F.translate(q, _ENDS, _SHIELDS))
    return F.array_join(F.flatten(F.zip_with(around, held, lambda a, q: F.array(a, F.coalesce(q, F.lit(""))))), "")


def restore_quotes(text: Column | str) -> Column:
    return F.translate(F.col(text) if isinstance(text, str) else text, _SHIELDS, _ENDS)


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of chunks of at most ``size`` characters that cover the text, each starting ``overlap`` or less before the last one's end.

    A cut follows the strongest separator in the second half of a chunk; a rest below ``LEAST`` joins the chunk before it if
    both stay within ``MOST``.
    """
    spans: list[tuple[int, int]] = []
    at, n = 0, len(text)
    while at < n:
        stop = min(n, at + size)
        if stop < n:
            for mark in SEPARATORS:
                k = text.rfind(mark, at + size // 2, stop) if mark else -1
                if k >= 0:
                    stop = k + len(mark)
                    break
        if spans and n - at < LEAST and n - spans[-1][0] <= MOST:
            spans[-1] = (spans[-1][0], n)
            break
        spans.append((at, stop))
        if stop >= n:
            break
        back = text.rfind(" ", max(at + 1, stop - overlap), stop - 1)
        at = back + 1 if back >= 0 else stop
    return spans


def split_documents(docs: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_index, char_start, char_end, content) of each document; null and empty texts have no chunk."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, i, a, b, t[a:b]) for d, t in zip(frame["doc_id"], frame[text], strict=True) if t for i, (a, b) in enumerate(split_text(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "char_start", "char_end", "content"])

    return docs.select("doc_id", text).mapInPandas(run, "doc_id bigint, chunk_index int, char_start int, char_end int, content string")


def locate(document: str, chunk: str, start: int = 0) -> tuple[int | None, str]:
    """(offset, how) of a chunk: as it is, with white space made alike, by its first or last 32 characters, else none."""
    k = document.find(chunk, start)
    k = k if k >= 0 else document.find(chunk)
    if k >= 0:
        return k, "exact"
    words = chunk.split()
    found = re.search(r"\s+".join(map(re.escape, words)), document) if words else None
    if found:
        return found.start(), "spaces"
    for part, shift in ((chunk[:32], 0), (chunk[-32:], len(chunk) - 32)):
        k = document.find(part) if len(part) == 32 else -1
        if k >= 0:
            return max(0, k - shift), "anchor"
    return None, "none"


def encode_vector(vector: list[float]) -> str:
    return base64.b64encode(np.asarray(vector, "<f4").tobytes()).decode()


def decode_vectors(rows: DataFrame, column: str, size: int) -> DataFrame:
    """Add embedding, null if the text isn't base64 of ``size`` finite floats."""

    def read(value: str | None) -> list[float] | None:
        try:
            v = np.frombuffer(base64.b64decode(value or "", validate=True), "<f4")
        except ValueError:
            return None
        return v.tolist() if len(v) == size and np.isfinite(v).all() else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(embedding=frame[column].map(read))

    return rows.mapInPandas(run, ", ".join(f"`{n}` {k}" for n, k in rows.dtypes) + ", embedding array<float>")


def to_markdown(text: Column | str) -> Column:
    """Underlined headers, bullets, rules and spacing in one style."""
    c = F.col(text) if isinstance(text, str) else text
    for pattern, by in (
        (r"(?m)^([^\n]+)\n={3,}$", "# $1"), (r"(?m)^([^\n]+)\n-{3,}$", "## $1"), (r"(?m)^(#{1,6})([^# \n])", "$1 $2"), (r"(?m)^[•*+] +", "- "),
        (r"(?m)^(?:\*{3,}|_{3,})$", "---"), (r"(?m)([^\n])\n(#{1,6} )", "$1\n\n$2"), ("\n{3,}", "\n\n"),
    ):
        c = F.regexp_replace(c, pattern, by)
    return c


def repair_citations(text: Column | str) -> Column:
    """Marks that lack an id or name no sentence go, doubled ones become one."""
    c = F.col(text) if isinstance(text, str) else text
    c = F.regexp_replace(c, r"\[\[cite:(?![A-Za-z0-9_-]+:S[0-9])[^\]]*\]\]", "")
    return F.regexp_replace(c, r"(\[\[cite:[^\]]+\]\])(?: *\1)+", "$1")
