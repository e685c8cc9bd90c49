"""Queries of the text functions over documents, pages and conversations."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom import model as m
from graphloom.catalog import query
from graphloom.functions import text as t
from graphloom.functions.categories import CATEGORIES, stripped
from graphloom.operators.relational import sql


def _docs(spark, d) -> DataFrame:
    return m.table(spark, d, "documents")


def _each(name: str, column, body: str, out: str) -> None:
    """Register a function of documents.text beside its SQL."""

    @query(name, f"SELECT doc_id, {body} AS {out} FROM documents")
    def run(spark, d):
        return _docs(spark, d).select("doc_id", column(F.col("text")).alias(out))


_each("fn_estimate_tokens", t.estimate_tokens, "CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS INTEGER)", "tokens")
_each("fn_control_chars", lambda c: F.length(t.strip_controls(F.concat(c, F.lit("\x07x\x1f")))), "CAST(length(regexp_replace(text || chr(7) || 'x' || chr(31), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]', '', 'g')) AS INTEGER)", "n")
_each("fn_unicode_bom", lambda c: F.md5(t.strip_bom(F.concat(F.lit("﻿"), c))), "md5(text)", "digest")
_TIDY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || '  ' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || 'end ', '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\x0b]+', ' ', 'g'), ' +\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"
_each("fn_whitespace", lambda c: F.md5(t.tidy_spaces(F.concat(c, F.lit("  \r\n\n\n\nend ")))), f"md5(regexp_replace({_TIDY}, '^[ \\n]+|[ \\n]+$', '', 'g'))", "digest")
_each("fn_text_ratio", t.text_ratio, "CASE WHEN length(text) = 0 THEN 0.0 ELSE round(length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / length(text), 3) END", "ratio")
_each("fn_alpha_ratio", t.alpha_ratio, "CASE WHEN length(regexp_replace(text, '[^\\p{L}\\p{N} ]', '', 'g')) = 0 THEN 0.0 ELSE round(length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / length(regexp_replace(text, '[^\\p{L}\\p{N} ]', '', 'g')), 4) END", "ratio")
_each("fn_gibberish", t.is_gibberish, "len(list_filter(string_split(lower(text), ' '), lambda w: w <> '')) > 0 AND len(list_filter(string_split(lower(text), ' '), lambda w: regexp_matches(w, '[bcdfghjklmnpqrstvwxz]{5}'))) / len(list_filter(string_split(lower(text), ' '), lambda w: w <> '')) > 0.3", "gibberish")
_each("fn_structure_score", lambda c: F.round(t.structure_score(c), 4), "CAST(round(least(1.0, 0.5 + CASE WHEN regexp_matches(text, '(?m)^#{1,6} ') THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(text, '(?m)^([*-]|[0-9]+\\.) ') THEN 0.1 ELSE 0 END + CASE WHEN contains(text, chr(10) || chr(10)) THEN 0.1 ELSE 0 END + CASE WHEN contains(text, '```') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(text, '(?m)^\\|.*\\|') THEN 0.05 ELSE 0 END), 4) AS DOUBLE)", "score")
_COMMON = "(" + ", ".join(f"'{w}'" for w in t.COMMON) + ")"
_W = "regexp_extract_all(lower(text), '[\\p{L}]+')"
_each("fn_language_confidence", lambda c: F.round(t.language_confidence(c), 6), f"CASE WHEN len({_W}) = 0 THEN 0.3 ELSE round(least(1.0, 0.3 + CASE WHEN length(array_to_string({_W}, '')) / len({_W}) BETWEEN 3 AND 8 THEN 0.3 ELSE 0.1 END + least(0.4, len(list_filter({_W}, lambda w: w IN {_COMMON})) / len({_W}))), 6) END", "confidence")
_each("fn_normalize_name_key", lambda c: F.md5(t.name_key(c)), "md5(lower(trim(strip_accents(text))))", "digest")
_each("fn_significant_words", lambda c: F.md5(F.array_join(t.significant_words(c), ",")), "md5(array_to_string(list_filter(string_split(regexp_replace(lower(trim(strip_accents(text))), '[., /-]+', ' ', 'g'), ' '), lambda w: length(w) > 1 AND w NOT IN ('mr', 'mrs', 'ms', 'dr', 'prof', 'sir', 'lady', 'lord', 'the')), ','))", "digest")
_each("fn_word_boundary", lambda c: t.at_word_boundary(c, F.lit("and")), "instr(text, 'and') > 0 AND (instr(text, 'and') = 1 OR NOT regexp_matches(substr(text, instr(text, 'and') - 1, 1), '[\\p{L}\\p{N}]')) AND NOT regexp_matches(substr(text, instr(text, 'and') + 3, 1), '[\\p{L}\\p{N}]')", "whole")
_each("fn_sentences_plain", lambda c: F.size(t.plain_sentences(c)), "CAST(len(string_split(regexp_replace(text, '([.!?])[ \\n\\t]+(\\p{Lu})', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS INTEGER)", "n")
_each("fn_numbered_sentences", lambda c: F.md5(t.numbered_sentences(F.split(c, "\n"))), "md5((SELECT string_agg('S' || i || ': ' || l[i], chr(10) ORDER BY i) FROM (SELECT string_split(text, chr(10)) AS l) x, unnest(range(1, len(l) + 1)) AS r(i)))", "digest")
_each("fn_edge_label", lambda c: F.md5(t.edge_label(c)), "md5(regexp_replace(regexp_replace(lower(trim(text)), '[ _\\t\\n]+', '_', 'g'), '^_+|_+$', '', 'g'))", "digest")
_each("fn_content_type", t.content_type, """CASE WHEN regexp_matches(left(trim(text), 1000), '(?i)<!doctype html|<html[ >]|<head[ >]|<body[ >]|<div[ >]|<p[ >]|<script[ >]') THEN 'html' WHEN regexp_matches(trim(text), '^[\\[{]') AND regexp_matches(trim(text), '[\\]}]$') THEN 'json'
  WHEN (SELECT count(*) >= 2 AND min(c) = max(c) AND min(c) > 0 FROM (SELECT length(x) - length(replace(x, ',', '')) AS c FROM unnest(list_filter(string_split(trim(text), chr(10)), lambda x: trim(x) <> '')[1:5]) AS u(x))) THEN 'csv'
  WHEN regexp_matches(trim(text), '(?m)^#{1,6} |^[*-] |^```') THEN 'markdown' WHEN regexp_matches(trim(text), '(?m)^(def|class|import|function|public|#include)[ (]') THEN 'code' ELSE 'text' END""", "kind")


@query("fn_parse_sent_ref", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE array_to_string(CASE event_id % 5 WHEN 0 THEN [event_id % 7 + 1] WHEN 1 THEN [1, 2, 3] WHEN 2 THEN [2, 4, 5] ELSE NULL END, ',') END AS refs FROM events")
def fn_parse_sent_ref(spark, d):
    k = F.col("event_id") % 5
    ref = F.when(k == 0, F.concat(F.lit("S"), F.col("event_id") % 7 + 1)).when(k == 1, "s1-S3").when(k == 2, "S4-S5; S2, S4").when(k == 3, "S9-S11").otherwise("first")
    return m.table(spark, d, "events").select("event_id", F.array_join(t.sentence_refs(ref, F.lit(10)).cast("array<string>"), ",").alias("refs"))


@query("fn_safe_float", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0.8 ELSE least(1.0, value / 100) END AS confidence FROM events".replace("value / 100", "CAST(value AS DOUBLE)"))
def fn_safe_float(spark, d):
    raw = F.when(F.col("event_id") % 10 == 0, "none").otherwise(F.concat(F.lit("about "), F.col("value")))
    return m.table(spark, d, "events").select("event_id", t.safe_float(raw).alias("confidence"))


@query("fn_unescape_field", "SELECT p_partkey, p_name || '|' || p_brand AS field FROM part")
def fn_unescape_field(spark, d):
    raw = F.concat(F.lit("**"), "p_name", F.lit("\\|"), "p_brand", F.lit("**"))
    return m.table(spark, d, "part").select("p_partkey", t.unescape_field(raw).alias("field"))


@query("fn_embedding_text", "SELECT p_partkey, p_name || ' | Also known as: ' || p_brand || ', ' || p_type || CASE WHEN p_partkey % 2 = 0 THEN ' | size ' || p_size ELSE '' END AS text FROM part")
def fn_embedding_text(spark, d):
    description = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("size "), "p_size")).otherwise("")
    return m.table(spark, d, "part").select("p_partkey", t.embedding_text(F.col("p_name"), F.array("p_brand", "p_type"), description).alias("text"))


@query("alias_parse", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ',' || p_brand ELSE p_name || ',' || p_type END AS aliases FROM part")
def alias_parse(spark, d):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("; none;"), "p_brand", F.lit("; [x]"))).otherwise(F.concat("p_name", F.lit(", "), "p_type", F.lit(", "), "p_name"))
    return m.table(spark, d, "part").select("p_partkey", F.array_join(t.aliases_of(raw), ",").alias("aliases"))


_TYPE_GROUPS = {"metals": ["Economy", "PROMO"], "sizes": ["small", "LARGE", "Medium"], "mixed": ["Promo", "standard"]}


@query("fn_types_compatible", """SELECT p_partkey, k = o OR o = 'thing' OR (k IN ('economy', 'promo') AND o IN ('economy', 'promo')) OR (k IN ('small', 'large', 'medium') AND o IN ('small', 'large', 'medium')) OR (k IN ('promo', 'standard') AND o IN ('promo', 'standard')) AS fits
  FROM (SELECT p_partkey, lower(trim(p_type, ' ')) AS k, ['thing', 'economy', 'large', 'promo', 'standard'][p_partkey % 5 + 1] AS o FROM part)""")
def fn_types_compatible(spark, d):
    other = F.get(F.array(*[F.lit(x) for x in ("Thing", "Economy", "LARGE ", "promo", "Standard")]), (F.col("p_partkey") % 5).cast("int"))
    return m.table(spark, d, "part").select("p_partkey", t.types_compatible(F.col("p_type"), other, _TYPE_GROUPS).alias("fits"))


@query("fn_hamming", "SELECT a.p_partkey, CAST(bit_count(xor(a.p_partkey * 7919, a.p_size * 104729)) AS INTEGER) AS distance FROM part a")
def fn_hamming(spark, d):
    return m.table(spark, d, "part").select("p_partkey", F.bit_count((F.col("p_partkey") * 7919).bitwiseXOR(F.col("p_size").cast("bigint") * 104729)).alias("distance"))


@query("fn_simhash64", """WITH h AS (SELECT doc_id, CAST('0x' || substr(sha256(w), 49, 16) AS UBIGINT) AS h FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)), n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY 1),
  b AS (SELECT doc_id, i, count(*) FILTER (WHERE (h >> i) & 1 = 1) AS k FROM h, range(64) AS r(i) GROUP BY 1, 2) SELECT doc_id, printf('%016x', bit_or(CASE WHEN 2 * k > n THEN 1::UBIGINT << i::UBIGINT ELSE 0::UBIGINT END)) AS fingerprint FROM b JOIN n USING (doc_id) GROUP BY 1""")
def fn_simhash64(spark, d):
    """Of all words of each document."""
    return _docs(spark, d).select("doc_id", F.lower(F.lpad(F.hex(t.simhash(F.split("text", " "))), 16, "0")).alias("fingerprint"))


@query("fn_sentences")
def fn_sentences(spark, d):
    return t.split_sentences(_docs(spark, d).select("doc_id", "text")).select("doc_id", F.size("sentences").alias("n"))


def web_basic_sql(html: str = "html") -> str:
    """(page_id, digest) of pages' text by the same rules."""
    return """SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(""" + html + """, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?is)<nav[^>]*>.*?</nav>', '', 'g'), '(?is)<footer[^>]*>.*?</footer>', '', 'g'), '(?is)<header[^>]*>.*?</header>', '', 'g'), '(?is)<aside[^>]*>.*?</aside>', '', 'g'),
  '(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr)[^>]*>', chr(10), 'g'), '(?s)<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '[ \\t]+', ' ', 'g'), '\\n[ \\n]*\\n', chr(10) || chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')) AS digest FROM pages"""


@query("text_web_basic", web_basic_sql())
def text_web_basic(spark, d):
    return m.table(spark, d, "pages").select("page_id", F.md5(t.web_basic("html")).alias("digest"))


@query("fn_looks_like_html", "SELECT page_id, page_id % 2 = 0 AND regexp_matches(left(html, 1000), '(?i)<!doctype html|<html[ >]|<head[ >]|<body[ >]|<div[ >]|<p[ >]|<script[ >]') AS html FROM pages")
def fn_looks_like_html(spark, d):
    text = F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise("plain < text >")
    return m.table(spark, d, "pages").select("page_id", t.looks_like_html(text).alias("html"))


@query("fn_length_reduction", "SELECT page_id, round(greatest(0.0, 1 - length(regexp_replace(html, '(?s)<[^>]+>', '', 'g')) / length(html)), 3) AS reduction FROM pages")
def fn_length_reduction(spark, d):
    return m.table(spark, d, "pages").select("page_id", t.length_reduction("html", F.regexp_replace("html", "(?s)<[^>]+>", "")).alias("reduction"))


@query("ocr_page_artifacts", sql("SELECT doc_id, count(*) AS kept FROM (SELECT doc_id, content, count(*) OVER (PARTITION BY doc_id, trim(content)) AS times FROM chunks) WHERE NOT (times >= 3 AND length(trim(content)) < 80) AND NOT regexp_matches(trim(content), '^(Page|page)? ?[0-9]+( of [0-9]+)?$') GROUP BY doc_id"))
def ocr_page_artifacts(spark, d):
    """Lines of a document that aren't page numbers nor short and repeated three times in it."""
    line = F.trim("content")
    c = m.chunks(spark, d).withColumn("times", F.count("*").over(Window.partitionBy("doc_id", line)))
    kept = c.where(~((F.col("times") >= 3) & (F.length(line) < 80)) & ~line.rlike(r"^(Page|page)? ?[0-9]+( of [0-9]+)?$"))
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("para_dedup", sql("SELECT doc_id, count(DISTINCT md5(regexp_replace(lower(content), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS paragraphs FROM chunks WHERE length(trim(content)) > 0 GROUP BY doc_id"))
def para_dedup(spark, d):
    """Paragraphs that differ in more than case and punctuation."""
    key = F.md5(F.regexp_replace(F.lower("content"), r"[^\p{L}\p{N}]+", " "))
    c = m.chunks(spark, d).where(F.length(F.trim("content")) > 0)
    return c.select("doc_id", key.alias("key")).distinct().groupBy("doc_id").agg(F.count("*").alias("paragraphs"))


@query("normalize_pipeline", """SELECT doc_id, length(clean) AS clean_chars, round(greatest(0.0, 1 - length(clean) / length(text)), 3) AS reduction FROM (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\x0b]+', ' ', 'g'), ' +\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g') AS clean FROM documents)""".replace("length(clean) AS", "CAST(length(clean) AS INTEGER) AS"))
def normalize_pipeline(spark, d):
    from graphloom.registry import CLEANERS, clean

    assert CLEANERS
    x = clean(_docs(spark, d).select("doc_id", "text"), "text", "clean")
    return x.select("doc_id", F.length("clean").alias("clean_chars"), t.length_reduction("text", "clean").alias("reduction"))


_KINDS = ["toc", "legal", "boilerplate", "data_tables", "procedural", "web_artifacts", "bulk_lists", "changelog"]
# Fixed values of the test: what stands before the text of every eighth document and so on.
_HEADS = ("- one\n- two of it\n* three\n", "Copyright 2020. All rights reserved.\n", "| a | b |\n|--|--|\n| 1 | 2 |\n", "We use cookies. Cookie policy.\n", "", "=====\n-----\n~~~~\n*****\n#####\n", "1. Click it\n2) Open\n3. Run\n4. Install x\n5. Choose y\n", "New in version 3\nAdded in version 4\n")


def _category_sql() -> str:
    heads = "[" + ", ".join("'" + h.replace("\n", "' || chr(10) || '") + "'" for h in _HEADS) + "]"
    steps = [f"c0 AS (SELECT doc_id, {heads}[doc_id % 8 + 1] || text AS clean, '' AS categories FROM documents)"]
    for k, name in enumerate(_KINDS):
        c = CATEGORIES[name]
        pattern = c.pattern.replace("'", "''")
        if c.mode == "count":
            hit = f"len(regexp_extract_all(clean, '{pattern}')) >= {c.threshold}" + (" OR length(trim(clean)) < 100" if name == "boilerplate" else "")
            left = "''"
        else:
            lines = "list_filter(string_split(clean, chr(10)), lambda x: length(trim(x)) > 0)"
            hit = f"len({lines}) > 0 AND len(list_filter({lines}, lambda x: regexp_matches(x, '{pattern}'))) / len({lines}) >= {c.threshold}"
            left = f"array_to_string(list_filter(string_split(clean, chr(10)), lambda x: NOT (length(trim(x)) > 0 AND regexp_matches(x, '{pattern}'))), chr(10))"
        steps.append(f"h{k} AS (SELECT *, {hit} AS hit FROM c{k}), c{k + 1} AS (SELECT doc_id, CASE WHEN hit THEN {left} ELSE clean END AS clean, CASE WHEN hit THEN categories || ' {name}' ELSE categories END AS categories FROM h{k})")
    return f"WITH {', '.join(steps)} SELECT doc_id, md5(clean) AS digest, categories, categories <> '' AND length(trim(clean)) < 100 AS excluded FROM c{len(_KINDS)}"


@query("content_category", _category_sql())
def content_category(spark, d):
    """What eight categories, one after the other, take out of documents that start with things of that kind."""
    head = F.get(F.array(*[F.lit(h) for h in _HEADS]), (F.col("doc_id") % 8).cast("int"))
    rows = _docs(spark, d).select("doc_id", F.concat(head, F.col("text")).alias("text"))
    found = stripped(rows, _KINDS)
    return found.select("doc_id", F.md5("clean").alias("digest"), F.array_join(F.transform("categories", lambda c: F.concat(F.lit(" "), c)), "").alias("categories"), "excluded")


_CUSTOM = [{"regex": "^(the|der|la) ", "mode": "line_ratio", "threshold": 0.2}, {"regex": "(unclosed", "mode": "count"}, {"regex": "ING", "threshold": 40}]


@query("content_custom", """WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), h AS (SELECT doc_id, lines, list_filter(lines, lambda x: trim(x, ' ') <> '') AS full_, list_filter(lines, lambda x: regexp_matches(x, '(?i)^(the|der|la) ')) AS alike FROM l),
  a AS (SELECT doc_id, len(full_) > 0 AND len(alike) / len(full_) >= 0.2 AS hit, array_to_string(list_filter(lines, lambda x: NOT regexp_matches(x, '(?i)^(the|der|la) ')), chr(10)) AS left_, array_to_string(lines, chr(10)) AS whole FROM h),
  b AS (SELECT doc_id, hit, CASE WHEN hit THEN left_ ELSE whole END AS clean FROM a), c AS (SELECT *, len(regexp_extract_all(clean, '(?i)ing')) >= 40 AS many FROM b)
  SELECT doc_id, md5(CASE WHEN many THEN '' ELSE clean END) AS digest, CASE WHEN hit THEN 'custom_0 ' ELSE '' END || CASE WHEN many THEN 'custom_2 ' ELSE '' END AS custom FROM c""")
def content_custom(spark, d):
    """Categories of users' patterns, one of which doesn't compile."""
    from graphloom.functions.user_patterns import compiled, strip_categories

    found = strip_categories(_docs(spark, d).select("doc_id", "text"), compiled(_CUSTOM)[0])
    return found.select("doc_id", F.md5("clean").alias("digest"), F.array_join(F.transform("custom", lambda c: F.concat(c, F.lit(" "))), "").alias("custom"))


@query("parse_llm_lines", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'E' WHEN 1 THEN 'R' WHEN 2 THEN 'P' END AS kind, p_partkey % 4 < 3 AND p_partkey % 9 <> 0 AS valid FROM part")
def parse_llm_lines(spark, d):
    k, cut = F.col("p_partkey") % 4, F.when(F.col("p_partkey") % 9 == 0, F.lit("|surplus|more")).otherwise(F.lit(""))
    line = (
        F.when(k == 0, F.concat(F.lit("- E|"), "p_name", F.lit("|Part|alias|0.9|S1|a \\| b"), cut, F.lit("|")))
        .when(k == 1, F.concat(F.lit("R|0|1|uses|0.8|S2|because"), cut))
        .when(k == 2, F.concat(F.lit("P|0|size|"), "p_size", cut))
        .otherwise("no record here")
    )
    rows = m.table(spark, d, "part").select(F.col("p_partkey").alias("id"), line.alias("text"))
    return t.parse_lines(rows).select("id", "kind", "valid")


@query("citation_extract", "SELECT doc_id, 'chunk' || (doc_id % 7) AS cited, 'S1,S' || (doc_id % 5 + 1) AS refs FROM documents")
def citation_extract(spark, d):
    answer = F.concat(F.coalesce("text", F.lit("")), F.lit("[[cite:chunk"), F.col("doc_id") % 7, F.lit(":S1,S"), F.col("doc_id") % 5 + 1, F.lit("|see]] and [[node_x|y]]"))
    return _docs(spark, d).select("doc_id", F.explode(t.citations_in(answer)).alias("c")).select("doc_id", F.col("c.id").alias("cited"), "c.refs")


def located_quotes(quotes: DataFrame, chunks: DataFrame, head: int = 60) -> DataFrame:
    """(doc_id, chunk_index, sentence) of quotes (doc_id, quote): the first chunk of the document that holds the first ``head`` characters, and the number of the
    sentence they start in. Quotes that no chunk holds are left out."""
    wanted = quotes.where(F.length(F.trim("quote")) > 0).select("doc_id", F.left(F.trim("quote"), F.lit(head)).alias("_quote"))
    met = chunks.select("doc_id", "chunk_index", "content").join(wanted, "doc_id").where(F.contains("content", F.col("_quote")))
    first = met.groupBy("doc_id", "_quote").agg(F.min(F.struct("chunk_index", "content")).alias("x"))
    before = F.left(F.col("x.content"), F.call_function("locate", F.col("_quote"), F.col("x.content")) - 1)
    return first.select("doc_id", "x.chunk_index", F.size(F.split(before, r"[.!?] ")).alias("sentence"))


_QUOTED = "SELECT doc_id, chunk_index AS k, substr(trim(content), 1 + length(trim(content)) // 3, 80) AS quote FROM chunks c WHERE chunk_index = doc_id % (SELECT count(*) FROM chunks n WHERE n.doc_id = c.doc_id)"
_PLAIN_QUOTE = "lower(trim(regexp_replace(translate({0}, '–—‘’“”', '--' || chr(39) || chr(39) || chr(34) || chr(34)), '[ \\n\\t]+', ' ', 'g')))"


def _quoted(spark, d) -> DataFrame:
    """From one chunk of each document, what starts at a third of it."""
    c = m.chunks(spark, d)
    n = c.groupBy("doc_id").agg(F.count("*").alias("n"))
    line = F.trim("content")
    return c.join(n, "doc_id").where(F.col("chunk_index") == F.col("doc_id") % F.col("n")).select("doc_id", F.col("chunk_index").alias("k"), F.call_function("substr", line, 1 + F.floor(F.length(line) / 3).cast("int"), F.lit(80)).alias("quote"))


@query("quote_locate", sql(f"""WITH q AS (SELECT doc_id, left(trim(quote), 60) AS quote FROM ({_QUOTED}) WHERE length(trim(quote)) > 0), f AS (SELECT c.doc_id, arg_min(content, chunk_index) AS content, min(chunk_index) AS chunk_index, any_value(quote) AS quote FROM chunks c JOIN q ON q.doc_id = c.doc_id AND contains(content, quote) GROUP BY c.doc_id)
  SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(len(regexp_split_to_array(left(content, instr(content, quote) - 1), '[.!?] ')) AS INTEGER) AS sentence FROM f"""))
def quote_locate(spark, d):
    return located_quotes(_quoted(spark, d).select("doc_id", "quote"), m.chunks(spark, d))


def grounded_quotes(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add grounded to (chunk_id, quote): whether the cited chunk holds the quote, but for dashes, quotation marks, blanks and case.

    A chunk that doesn't exist grounds nothing; an empty quote needs only its chunk.
    """
    cited = answers.join(chunks.select("chunk_id", F.col("content").alias("_content")), "chunk_id", "left")
    return cited.withColumn("grounded", F.coalesce(F.contains(t.normal_quote("_content"), t.normal_quote(F.coalesce("quote", F.lit("")))), F.lit(False))).drop("_content")


@query("grounding_validate", sql(f"""WITH a AS (SELECT doc_id, doc_id * 16777216 + CASE WHEN doc_id % 5 = 0 THEN 99999 WHEN doc_id % 3 = 0 THEN 0 ELSE k END AS chunk_id, replace(quote, ' ', '  ') AS quote FROM ({_QUOTED}))
  SELECT a.doc_id, coalesce(contains({_PLAIN_QUOTE.format('content')}, {_PLAIN_QUOTE.format('quote')}), false) AS grounded FROM a LEFT JOIN chunks c ON c.chunk_id = a.chunk_id"""))
def grounding_validate(spark, d):
    """Quotes of a chunk that cite it, another chunk, or none that exists."""
    k = F.when(F.col("doc_id") % 5 == 0, 99999).when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("k"))
    answers = _quoted(spark, d).select("doc_id", (F.col("doc_id") * 16777216 + k).alias("chunk_id"), F.replace("quote", F.lit(" "), F.lit("  ")).alias("quote"))
    return grounded_quotes(answers, m.chunks(spark, d)).select("doc_id", "grounded")


@query("date_filters", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-02-01'")
def date_filters(spark, d):
    o = m.table(spark, d, "orders")
    return o.where((F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1998-02-01").cast("timestamp"))).select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("fn_threshold_score", "SELECT doc_id, CASE WHEN n_chars >= 5000 THEN 20.0 WHEN n_chars >= 1000 THEN 12.0 WHEN n_chars >= 100 THEN 5.0 ELSE 1.0 END AS score FROM documents".replace("20.0", "CAST(20 AS DOUBLE)"))
def fn_threshold_score(spark, d):
    from graphloom.operators.stats import steps

    return _docs(spark, d).select("doc_id", steps(F.col("n_chars"), [(5000, 20), (1000, 12), (100, 5)], 1).alias("score"))


@query("fn_cosine", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def fn_cosine(spark, d):
    from graphloom.operators.retrieval import cosine

    e = m.table(spark, d, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))  # one query row


@query("merge_descriptions", """WITH p AS (SELECT x.doc_id, coalesce(x.text, '') AS a, coalesce(y.text, '') AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1),
  w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(a), '[ \\t\\n\\r\\f\\x0b]+'), lambda v: v <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(lower(b), '[ \\t\\n\\r\\f\\x0b]+'), lambda v: v <> '')) AS y, regexp_replace(a, '[ \\t\\n\\r\\f\\x0b]+$', '') AS head FROM p),
  j AS (SELECT *, head || CASE WHEN head <> '' AND right(head, 1) NOT IN ('.', '!', '?') THEN '.' ELSE '' END || ' ' || regexp_replace(b, '^[ \\t\\n\\r\\f\\x0b]+|[ \\t\\n\\r\\f\\x0b]+$', '', 'g') AS both_ FROM w),
  c AS (SELECT *, substr(both_, 1, 1997) AS cut, instr(reverse(substr(both_, 1, 1997)), ' .') AS back FROM j)
  SELECT doc_id, md5(CASE WHEN a = '' OR contains(b, a) THEN substr(b, 1, 2000) WHEN b = '' OR contains(a, b) OR length(a) >= 2000 THEN substr(a, 1, 2000) WHEN len(x) = 0 OR len(y) = 0 OR len(list_intersect(x, y)) / greatest(len(x), len(y)) > 0.5 THEN substr(CASE WHEN length(a) >= length(b) THEN a ELSE b END, 1, 2000)
    WHEN length(both_) <= 2000 THEN both_ WHEN back > 0 AND 1996 - back > 1000 THEN substr(cut, 1, 1997 - back) ELSE regexp_replace(cut, '[ \\t\\n\\r\\f\\x0b]+$', '') || '...' END) AS digest FROM c""")
def merge_descriptions(spark, d):
    """Each document's text with the next one's, at most 2,000 characters."""
    from graphloom.operators.resolution import merged_description

    docs = m.table(spark, d, "documents")
    a, b = docs.select("doc_id", F.col("text").alias("a")), docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("b"))
    return a.join(b, "doc_id").select("doc_id", F.md5(merged_description(F.col("a"), F.col("b"), 2000)).alias("digest"))


@query("fn_unicode_nfc", "SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents")
def fn_unicode_nfc(spark, d):
    @F.pandas_udf("string")
    def nfc(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))

    @F.pandas_udf("string")
    def nfd(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else unicodedata.normalize("NFD", v))

    return _docs(spark, d).select("doc_id", F.md5(nfc(nfd("text"))).alias("digest"))


def mended(value: str | None) -> str | None:
    """Text that was UTF-8 and read as Windows-1252, read right; other text as it is."""
    if value is None or not any(c in value for c in "ÃÂâ"):
        return value
    try:
        return value.encode("cp1252").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return value


@query("fn_fix_encoding", "SELECT r_regionkey, 'café ' || r_name || ' – ñ' AS text FROM region")
def fn_fix_encoding(spark, d):
    @F.pandas_udf("string")
    def mend(x: pd.Series) -> pd.Series:
        return x.map(mended)

    broken = F.concat(F.lit("café ".encode().decode("cp1252")), "r_name", F.lit(" – ñ".encode().decode("cp1252")))
    return m.table(spark, d, "region").select("r_regionkey", mend(broken).alias("text"))


@query("merge_properties", """SELECT p_partkey, CASE WHEN length(p_brand) < 20 OR length(p_type) < 20 THEN CASE WHEN p_size >= 25 THEN p_brand ELSE p_type END WHEN length(p_brand) >= length(p_type) THEN p_brand ELSE p_type END AS short,
  CASE WHEN length(p_name || ' and the rest of it') >= length(p_brand || ' with a longer description') THEN p_name || ' and the rest of it' ELSE p_brand || ' with a longer description' END AS long, CASE WHEN p_size = 7 THEN '[' || p_size || ',"x"]' ELSE '[' || p_size || ',"x",7]' END AS list,
  p_size AS mixed, 'both' AS nested_same, p_partkey AS nested_kept, p_partkey + 1 AS nested_other FROM part""")
def merge_properties(spark, d):
    """Texts, lists, objects and values of different kinds in the properties of an entity and its duplicate."""
    from graphloom.functions.properties import deep_merged, surer_value

    kept = F.struct(
        F.col("p_brand").alias("short"), F.concat("p_name", F.lit(" and the rest of it")).alias("long"), F.array(F.col("p_size").cast("string"), F.lit("x")).alias("list"), F.col("p_size").alias("mixed"),
        F.struct(F.lit("both").alias("same"), F.col("p_partkey").alias("kept")).alias("nested"),
    )
    other = F.struct(
        F.col("p_type").alias("short"), F.concat("p_brand", F.lit(" with a longer description")).alias("long"), F.array(F.lit("7"), F.col("p_size").cast("string")).alias("list"), F.col("p_type").alias("mixed"),
        F.struct(F.lit("both").alias("same"), (F.col("p_partkey") + 1).alias("other")).alias("nested"),
    )
    numbers = lambda c: F.regexp_replace(F.to_json(c), '"([0-9]+)"', "$1")
    sure = surer_value(F.col("p_size") / 50, F.lit(0.5))
    o = m.table(spark, d, "part").select("p_partkey", deep_merged(F.parse_json(numbers(kept)), F.parse_json(numbers(other)), sure).alias("o"))
    get = lambda path, kind: F.variant_get("o", path, kind)
    return o.select(
        "p_partkey", get("$.short", "string").alias("short"), get("$.long", "string").alias("long"), F.to_json(get("$.list", "variant")).alias("list"), get("$.mixed", "int").alias("mixed"),
        get("$.nested.same", "string").alias("nested_same"), get("$.nested.kept", "bigint").alias("nested_kept"), get("$.nested.other", "bigint").alias("nested_other"),
    )
