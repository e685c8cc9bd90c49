"""Queries of chunking, and the choice of chunks that stand for a source."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import model as m
from graphloom.catalog import query
from graphloom.functions import alignment as al
from graphloom.functions import chunking as c
from graphloom.functions import text as t


@query("chunk_split")
def chunk_split(spark, d):
    return c.split_documents(m.table(spark, d, "documents")).select("doc_id", "chunk_index", "char_start", "char_end")


@query("chunk_coverage", "SELECT doc_id, CAST(length(text) AS INTEGER) AS covered, 0 AS first FROM documents WHERE length(text) > 0")
def chunk_coverage(spark, d):
    """Chunks reach from the first character to the last."""
    parts = c.split_documents(m.table(spark, d, "documents"))
    return parts.groupBy("doc_id").agg(F.max("char_end").alias("covered"), F.min("char_start").alias("first"))


def _preprocess_sql() -> str:
    """Four pages made of each text with heads, numbers, contents and structure put in, and the passes that take them out."""
    q = lambda p: p.replace("'", "''")
    rep = lambda value, pattern, by: f"regexp_replace({value}, '{q(pattern)}', {by}, 'g')"
    n2 = "chr(10) || chr(10)"
    cleaned = "x"
    for pattern in (c.PAGE_NUMBER, c.STRUCTURE, c.CONTENTS):
        cleaned = rep(cleaned, pattern, "''")
    cleaned = rep(f"replace({cleaned}, chr(12), {n2})", r"\n{3,}", n2)
    flow = rep(rep("y", c.PAGE_HEAD, n2), r"([\p{Ll}]),?\n\n([\p{Ll}])", r"'\1 \2'")
    flow = f"trim({rep(f'replace({rep(f"replace({flow}, {n2}, chr(1))", r"[ \t]*\n[ \t]*", "' '")}, chr(1), {n2})', '[ \t]{2,}', "' '")}, ' ')"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) // 4 AS q FROM documents),
  n AS (SELECT doc_id, 'CHAPTER IV' || chr(10) || 'One ..... 3' || chr(10) || 'Two ...... 9' || chr(10) || '1.2 Three' || chr(10) || substr(text, 1, q) || chr(12) || 'Running head' || chr(10) || substr(text, q + 1, q) || chr(12) || 'Running head' || chr(10) || '- 12 -' || chr(10) || substr(text, 2 * q + 1, q) || chr(12) || 'Running head ' || chr(10) || substr(text, 3 * q + 1) AS text FROM t),
  pages AS (SELECT doc_id, p, parts[p] AS body FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS p FROM (SELECT doc_id, string_split_regex(text, '{c.PAGE_BREAK}') AS parts FROM n))),
  heads AS (SELECT doc_id, list(line) AS heads FROM (SELECT doc_id, line FROM (SELECT DISTINCT doc_id, p, trim(unnest(string_split(body, chr(10))), ' ') AS line FROM pages) WHERE line <> '' GROUP BY ALL HAVING count(*) >= {c.REPEATED}) GROUP BY doc_id),
  x AS (SELECT doc_id, array_to_string(list_filter(string_split(replace(text, chr(12), chr(12) || chr(10)), chr(10)), lambda l: NOT list_contains(coalesce(heads, []), trim(l, ' '))), chr(10)) AS x FROM n LEFT JOIN heads USING (doc_id)), y AS (SELECT doc_id, {cleaned} AS y FROM x)
  SELECT doc_id, md5({flow}) AS digest FROM y"""


@query("chunk_preprocess", _preprocess_sql())
def chunk_preprocess(spark, d):
    """Whole texts as four pages with a running head, page numbers, a chapter's mark and contents, cleaned."""
    t_, q = F.coalesce("text", F.lit("")), F.floor(F.length(F.coalesce("text", F.lit(""))) / 4).cast("int")
    part = lambda k: F.substring(t_, q * k + 1, q) if k < 3 else F.substring(t_, q * 3 + 1, F.length(t_))
    noisy = F.concat(
        F.lit("\ufeffCHAPTER IV\r\nOne ..... 3\nTwo ...... 9\n1.2 Three\n"), part(0), F.lit("\fRunning head\n"), part(1), F.lit("\fRunning head\n- 12 -\n"), part(2), F.lit("\fRunning head \n"), part(3),
    )
    return c.preprocessed(m.table(spark, d, "documents").select("doc_id", noisy.alias("text"))).select("doc_id", F.md5("text").alias("digest"))


def _windows(docs: DataFrame, size: int = 400) -> DataFrame:
    """Texts cut every ``size`` characters."""
    each = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int"))).alias("chunk_index"))
    return each.select("doc_id", "chunk_index", F.substring("text", F.col("chunk_index") * size + 1, F.lit(size)).alias("content"))


@query("chunk_offsets", """WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, text FROM documents WHERE length(text) > 0), r(doc_id, chunk_index, char_start) AS (SELECT doc_id, 0, 0 FROM t
  UNION ALL SELECT r.doc_id, chunk_index + 1, CASE WHEN instr(substr(text, char_start + 2), substr(text, 400 * chunk_index + 401, 400)) > 0 THEN char_start + instr(substr(text, char_start + 2), substr(text, 400 * chunk_index + 401, 400)) ELSE instr(text, substr(text, 400 * chunk_index + 401, 400)) - 1 END FROM r JOIN t USING (doc_id) WHERE length(text) > 400 * (chunk_index + 1))
  SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(char_start AS BIGINT) AS char_start, 'exact' AS method FROM r""")
def chunk_offsets(spark, d):
    """All pieces of all documents, each behind the one before it."""
    docs = m.table(spark, d, "documents").select("doc_id", "text")
    return al.chunk_offsets(docs, _windows(docs)).select("doc_id", "chunk_index", "char_start", "method")


@query("chunk_offsets_changed")
def chunk_offsets_changed(spark, d):
    """Pieces of texts in originals with other line ends, with lines more, with changed letters, or of another document; tested against what was done to them."""
    docs = m.table(spark, d, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.replace("text", F.lit("\n"), F.lit(" \r\n\t"))).when(k == 1, F.regexp_replace("text", r"(.{220})", "$1\n-- 12 --\n")).when(k == 2, F.regexp_replace("text", r"(.{9}).", "$1~")).otherwise(F.reverse("text"))
    return al.chunk_offsets(docs.select("doc_id", text.alias("text")), _windows(docs))


@query("embedding_codec", "SELECT vec_id, vec_id % 5 <> 0 AND vec_id % 7 <> 0 AND vec_id % 11 <> 0 AS valid, CASE WHEN vec_id % 5 <> 0 AND vec_id % 7 <> 0 AND vec_id % 11 <> 0 THEN round(list_sum(CAST(embedding AS DOUBLE[])), 4) END AS total FROM embeddings")
def embedding_codec(spark, d):
    """Vectors written as text and read again; some aren't base64, some too short, some hold no number."""

    def encode(frames):
        for f in frames:
            bad = lambda i, v: "not base64!" if i % 5 == 0 else c.encode_vector(v[:-1]) if i % 7 == 0 else c.encode_vector([float("nan"), *v[1:]]) if i % 11 == 0 else c.encode_vector(v)
            yield pd.DataFrame({"vec_id": f["vec_id"], "blob": [bad(i, list(v)) for i, v in zip(f["vec_id"], f["embedding"], strict=True)]})

    rows = m.table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(encode, "vec_id bigint, blob string")
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4)
    return c.decode_vectors(rows, "blob", 64).select("vec_id", F.col("embedding").isNotNull().alias("valid"), total.alias("total"))


@query("markdown_transforms", "SELECT p_partkey, '# ' || p_name || chr(10) || chr(10) || '## ' || p_brand || chr(10) || '- ' || p_type AS text FROM part")
def markdown_transforms(spark, d):
    raw = F.concat("p_name", F.lit("\n=====\n"), F.lit("##"), "p_brand", F.lit("\n• "), "p_type")
    return m.table(spark, d, "part").select("p_partkey", c.to_markdown(raw).alias("text"))


@query("citation_repair", "SELECT doc_id, 'see [[cite:c1:S1]] and ' || doc_id AS text FROM documents")
def citation_repair(spark, d):
    raw = F.concat(F.lit("see [[cite:c1:S1]] [[cite:c1:S1]] and [[cite:]]"), F.col("doc_id"))
    return m.table(spark, d, "documents").select("doc_id", c.repair_citations(raw).alias("text"))


_SCANNED = ("xqzvbnm trwqpsdf", "i", "Hi", "by", "IV", "i e f", "a b", "aaaa", "# a", "- x", "3)", "---", "cat", "!!", "12345678 9", "aBcDeFgHiJ", "AbA CdC EfE AbAbAbAb", "é à")
_SCAN_KEEPS = (False, False, False, True, True, True, False, False, True, True, True, False, True, False, False, True, False, True)


def _scan_sql() -> str:
    """Lines of documents by the same rules, with the rules' words and shapes."""
    q = lambda v: "(" + ", ".join("'" + x + "'" for x in v) + ")"
    added = "chr(10) || " + " || chr(10) || ".join("'" + x + "'" for x in _SCANNED)
    return f"""WITH l AS (SELECT doc_id, i, regexp_replace(lines[i], '^\\s+|\\s+$', '', 'g') AS t FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, '') || {added}, chr(10)) AS lines FROM documents))),
  w AS (SELECT *, lower(trim(regexp_replace(t, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), ' ')) AS word FROM l),
  s AS (SELECT *, word IN {q(t.SCAN_NOISE)} OR regexp_matches(t, '{t.NOISE_SHAPES}') OR (length(t) > 1 AND replace(t, t[1], '') = '' AND NOT regexp_matches(t[1], '(?i)[ivxlcdm]')) AS noise, regexp_matches(t, '{t.STRUCTURAL_LINE}') OR word IN {q(t.KEPT_WORDS)} OR regexp_matches(t, '{t.ROMAN}') AS stays,
    length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')) AS counted, length(t) - length(regexp_replace(t, '(?i)[bcdfghjklmnpqrstvwxyz]{{5,}}', '', 'g')) AS clusters, string_split_regex(t, '\\s+') AS words FROM w),
  k AS (SELECT doc_id, CASE WHEN t = '' THEN true WHEN length(t) < 5 THEN CASE WHEN noise THEN false WHEN stays THEN true ELSE word <> '' END
    ELSE counted > 0 AND letters / greatest(counted, 1) >= 0.5 AND NOT (length(t) >= 10 AND (clusters / length(t) > 0.3 OR (regexp_matches(t, '([A-Z][a-z]){{4,}}|([a-z][A-Z]){{4,}}') AND len(list_filter(words, lambda x: regexp_matches(x, '^[A-Z][a-z][A-Z]'))) > 0.5 * len(words)))) END AS keep FROM s)
  SELECT doc_id, count(*) FILTER (WHERE keep) AS kept, count(*) FILTER (WHERE NOT keep) AS removed FROM k GROUP BY doc_id"""


@query("ocr_gibberish_lines", _scan_sql())
def ocr_gibberish_lines(spark, d):
    """All lines of documents and, after them, lines of each kind that a scan has."""
    noisy = F.concat(F.coalesce("text", F.lit("")), F.lit("\n" + "\n".join(_SCANNED)))
    lines = m.table(spark, d, "documents").select("doc_id", F.explode(F.split(noisy, "\n")).alias("line")).withColumn("keep", t.keeps_line(F.col("line")))
    return lines.groupBy("doc_id").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("removed"))


@query("detect_encoding", "SELECT r_regionkey, r_name || ' é' AS text, 0 AS replaced FROM region")
def detect_encoding(spark, d):
    from graphloom.sources.loaders import decoded

    def read(frames):
        for f in frames:
            found = [decoded(bytes(x)) for x in f["data"]]
            yield pd.DataFrame({"r_regionkey": f["r_regionkey"], "text": [x[0] for x in found], "replaced": [x[1] for x in found]})

    value = F.concat("r_name", F.lit(" é"))
    data = F.when(F.col("r_regionkey") % 2 == 0, F.encode(value, "UTF-8")).otherwise(F.encode(value, "ISO-8859-1"))
    return m.table(spark, d, "region").select("r_regionkey", data.alias("data")).mapInPandas(read, "r_regionkey int, text string, replaced int")


@query("interpolate", "SELECT r_regionkey, 'region ' || r_name || ' has ' AS text FROM region")
def interpolate_query(spark, d):
    from graphloom.workflow import interpolate

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"r_regionkey": f["r_regionkey"], "text": [interpolate("region {{r.names.0}} has {{r.none}}", {"r": {"names": [x]}}) for x in f["r_name"]]})

    return m.table(spark, d, "region").mapInPandas(run, "r_regionkey int, text string")


@query("topo_sort", "SELECT * FROM (VALUES (0, 'load'), (1, 'clean'), (2, 'embed'), (3, 'extract'), (4, 'commit')) t(position, step)")
def topo_sort(spark, d):
    from graphloom.workflow import order

    found = order({"commit": ["extract", "embed"], "extract": ["clean"], "embed": ["clean"], "clean": ["load"], "load": []})
    return spark.createDataFrame(list(enumerate(found)), "position int, step string")


def representatives(chunks: DataFrame, budget: int, rounds: int = 20) -> DataFrame:
    """(source_id, chunk_index): all chunks of a source within the budget, else the nearest to each of ``budget`` centres.

    Centres start evenly spread over a source's chunks in order and move by Lloyd's steps, a source in one task: chunks of
    one source fit a worker.
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk_index", ignore_index=True)
        if len(frame) <= budget:
            return frame[["source_id", "chunk_index"]]
        x = np.array(frame["embedding"].tolist(), float)
        centres = x[np.linspace(0, len(x) - 1, budget).astype(int)]
        for _ in range(rounds):
            near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            after = np.array([x[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(budget)])
            if np.allclose(after, centres):
                break
            centres = after
        chosen = sorted({int(i) for i in ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=0)})
        return frame.iloc[chosen][["source_id", "chunk_index"]]

    return chunks.groupBy("source_id").applyInPandas(run, "source_id int, chunk_index bigint")


@query("summarize_select")
def summarize_select(spark, d):
    e = m.table(spark, d, "embeddings").select(F.col("label").alias("source_id"), F.col("vec_id").alias("chunk_index"), "embedding")
    return representatives(e, 8)


@query("backup_restore", "SELECT (SELECT count(*) FROM nation) AS nation, (SELECT count(*) FROM region) AS region, (SELECT count(*) FROM supplier) AS supplier")
def backup_restore(spark, d):
    """Tables copied to a new folder that counts as a backup once its last file, the list of tables, is written."""
    from graphloom.plans.scratch import scratch_path

    folder, names = scratch_path(spark, "backup"), ("nation", "region", "supplier")
    for n in names:
        m.table(spark, d, n).write.parquet(f"{folder}/{n}")
    spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.json(f"{folder}/tables")
    held = [r.name for r in spark.read.json(f"{folder}/tables").orderBy("name").collect()]
    return reduce(DataFrame.crossJoin, [spark.read.parquet(f"{folder}/{n}").agg(F.count("*").alias(n)) for n in held])
