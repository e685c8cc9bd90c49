"""Files as (path, content, metadata) documents, a loader for each kind of file."""

from __future__ import annotations

import csv
import html
import io
import json
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as t
from graphloom.registry import Registry

SCHEMA = "path string, part int, content string, warnings int"
#: Bytes of a file's head that a dialect is guessed from.
SNIFF = 8192


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """A document per row, "header: value" pairs joined by commas. Delimiter and header are guessed from the head of the first file."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, SNIFF).cast("string").alias("h")).first()
    sample = head.h if head else ""
    try:
        dialect = csv.Sniffer().sniff(sample, ",;\t|")
        delimiter = dialect.delimiter
        has_header = csv.Sniffer().has_header(sample)
    except csv.Error:
        delimiter, has_header = ",", True
    rows = spark.read.option("sep", delimiter).option("header", has_header).option("mode", "PERMISSIVE").csv(path)
    named = rows.columns if has_header else [f"column_{i}" for i in range(len(rows.columns))]
    pairs = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{n}: "), F.col(f"`{c}`"))) for c, n in zip(rows.columns, named, strict=True)]
    return rows.select(F.input_file_name().alias("path"), F.lit(0).alias("part"), F.concat_ws(", ", *pairs).alias("content"), F.lit(0).alias("warnings"))


def load_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A document per line that is JSON; others count as warnings of their file's first document."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), "value").where(F.trim("value") != "")
    marked = lines.withColumn("good", F.try_parse_json("value").isNotNull())
    bad = marked.where(~F.col("good")).groupBy("path").agg(F.count("*").cast("int").alias("warnings"))
    return marked.where("good").join(bad, "path", "left").select("path", F.lit(0).alias("part"), F.col("value").alias("content"), F.coalesce("warnings", F.lit(0)).alias("warnings"))


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """A document per file, indented."""
    return _by_file(spark, path, lambda name, data: [(json.dumps(json.loads(decoded(data)[0]), indent=2, ensure_ascii=False), 0)])


def load_text(spark: SparkSession, path: str) -> DataFrame:
    def read(name: str, data: bytes) -> list[tuple[str, int]]:
        value, replaced = decoded(data)
        return [(value, replaced)]

    return _by_file(spark, path, read)


def load_html(spark: SparkSession, path: str) -> DataFrame:
    return load_text(spark, path).withColumn("content", t.web_basic("content"))


def load_html_lines(spark: SparkSession, path: str) -> DataFrame:
    """A document per line, its name and its page parted by a tab: many pages in a file, as crawls store them, since a file a page costs more than the page."""
    line = spark.read.option("lineSep", "\n").text(path).select(F.split("value", "\t", 2).alias("p"))
    return line.select(F.get("p", F.lit(0)).alias("path"), F.lit(0).alias("part"), t.web_basic(F.concat(F.get("p", F.lit(1)), F.lit("\n"))).alias("content"), F.lit(0).alias("warnings"))


def decoded(data: bytes) -> tuple[str, int]:
    """(text, replaced characters): by byte order mark, as UTF-8, else as Windows-1252, else with replacements."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace"), 0
    for name in ("utf-8", "cp1252"):
        try:
            return data.decode(name), 0
        except UnicodeDecodeError:
            continue
    value = data.decode("utf-8", "replace")
    return value, value.count("�")


def _xml_text(data: bytes, paragraph: str, run: str) -> list[str]:
    found = []
    for p in ElementTree.fromstring(data).iter(paragraph):
        value = "".join(r.text or "" for r in p.iter(run))
        if value.strip():
            found.append(value)
    return found


_W, _A = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _docx(name: str, data: bytes) -> list[tuple[str, int]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [("\n".join(_xml_text(z.read("word/document.xml"), f"{_W}p", f"{_W}t")), 0)]


def _pptx(name: str, data: bytes) -> list[tuple[str, int]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        return [("\n".join(_xml_text(z.read(n), f"{_A}p", f"{_A}t")), 0) for n in slides]


def _xlsx(name: str, data: bytes) -> list[tuple[str, int]]:
    """A document per sheet: rows of cells joined by bars; empty rows are left out and counted."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(x.text or "" for x in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        out = []
        for n in sorted(x for x in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)):
            lines, skipped = [f"Sheet: {n[14:-4]}"], 0
            for row in ElementTree.fromstring(z.read(n)).iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    v = c.find(f"{_S}v")
                    inline = "".join(x.text or "" for x in c.iter(f"{_S}t"))
                    cells.append(inline if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or "")
                if any(x.strip() for x in cells):
                    lines.append(" | ".join(cells))
                else:
                    skipped += 1
            out.append(("\n".join(lines), skipped))
        return out


def _epub(name: str, data: bytes) -> list[tuple[str, int]]:
    """A document per chapter in the order of the spine."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        opf = next(n for n in z.namelist() if n.endswith(".opf"))
        root = ElementTree.fromstring(z.read(opf))
        items = {e.get("id"): e.get("href") for e in root.iter() if e.tag.endswith("}item")}
        base = opf.rpartition("/")[0]
        out = []
        for e in root.iter():
            if e.tag.endswith("}itemref") and items.get(e.get("idref")):
                chapter = z.read(f"{base}/{items[e.get('idref')]}".lstrip("/")).decode("utf-8", "replace")
                out.append((html.unescape(re.sub(r"\s*\n\s*", "\n", re.sub(r"(?s)<(script|style).*?</\1>|<[^>]+>", " ", chapter))).strip(), 0))
        return out


def _archive(name: str, data: bytes) -> list[tuple[str, int]]:
    """A document per text file inside."""
    kinds = (".md", ".txt", ".rst", ".json", ".yaml", ".yml", ".html")
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [decoded(z.read(n)) for n in sorted(z.namelist()) if n.lower().endswith(kinds)]
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        return [decoded(tar.extractfile(x).read()) for x in sorted(tar.getmembers(), key=lambda x: x.name) if x.isfile() and x.name.lower().endswith(kinds)]


def _by_file(spark: SparkSession, path: str, read: Callable[[str, bytes], list[tuple[str, int]]]) -> DataFrame:
    """``read`` over whole files; one that can't be read is an empty document with a warning."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    found = read(name, data)
                except Exception:  # noqa: BLE001  a broken file must not end the load
                    found = [("", 1)]
                out += [(name, i, content, warnings) for i, (content, warnings) in enumerate(found)]
            yield pd.DataFrame(out, columns=["path", "part", "content", "warnings"]).astype({"part": "int32", "warnings": "int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


LOADERS: Registry[Callable[[SparkSession, str], DataFrame]] = Registry()
for _ends, _load in (
    ((".csv", ".tsv"), load_csv), ((".jsonl", ".ndjson"), load_jsonl), ((".json",), load_json), ((".txt", ".md", ".log", ".rst"), load_text), ((".html", ".htm"), load_html),
    ((".docx",), lambda s, p: _by_file(s, p, _docx)), ((".pptx",), lambda s, p: _by_file(s, p, _pptx)), ((".xlsx",), lambda s, p: _by_file(s, p, _xlsx)), ((".epub",), lambda s, p: _by_file(s, p, _epub)),
    ((".zip", ".tar.gz", ".tgz"), lambda s, p: _by_file(s, p, _archive)),
):
    for _end in _ends:
        LOADERS.register(_end, _load)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file or a glob, by the longest extension that a loader is known for."""
    known = [e for e in LOADERS.names() if path.lower().endswith(e)]
    if not known:
        raise ValueError(f"no loader for {path}")
    return LOADERS[max(known, key=len)](spark, path)
