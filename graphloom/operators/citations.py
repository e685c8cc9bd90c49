"""Repairs of citation marks in answers: written one way, resolved, put right, moved to what they support, added to what lacks them.

Answers are rows (answer_id, text), ``retrieved`` what a model was given for each: (answer_id, alias, chunk_id, chunk_index, filename, content, sentence_offsets), the
offsets an array of (start, end). Marks are changed in columns; where a quotation has to be found, quotations meet the answer's chunks in a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import model as m
from graphloom.catalog import query
from graphloom.plans.scratch import materialise

# Grammar of marks and of what models write instead.
_ID, _REFS = r"(?:[a-z]+_)?[a-f0-9-]+", r"S\d+(?:[,;]\s*S\d+)*"
STRICT = rf"(?i)\[\[cite:({_ID})[:#]({_REFS})(?:\|([^\]]+))?\]\]"
LOOSE = r"(?i)\[\[cite:([^\]|]*)(?:\|([^\]]+))?\]\]"
RAW = rf"(?i)\[CHUNK\s+(C\d+|{_ID})(?:\s*\|\s*([^\]]+))?\]"
IN_WORDS = rf"(?i)\(Chunk\s+(C\d+|{_ID}),?\s*Sentences?\s+(S\d+(?:[,;\s]+S\d+)*)\)"
BARE = r"\((C\d+(?:\s*,\s*C\d+)*)\)"
ALIAS, SENTENCE, LIKE_ID = r"(?i)^C\d+$", r"(?i)^S\d+$", r"(?i)^(?:[a-z]+_)?[a-f0-9-]{8,}$"
SPAN = "(?:\"|“|«)([^\"”»]{12,})(?:\"|”|»)"
SHORT_SPAN = "(?:\"|“|«)([^\"”»\\n]{6,}?)(?:\"|”|»)"
BLOCK = r"(?m)^>[^\n]*(?:\n>[^\n]*)*"
BLANK_LINE = r"\n\s*\n"
# Characters of a quotation that are looked for, that a block must have, and a span.
KEY_CHARS, LEAST_BLOCK, LEAST_SPAN, LEAST_MOVE = 60, 40, 12, 6


def matches(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def each_match(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """``text`` with every match of ``pattern`` as ``change`` has it."""
    both = F.zip_with(F.split(text, pattern), F.transform(matches(text, pattern), change), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(both, "")


def tidy(text: Column) -> Column:
    """Runs of blanks inside a line, and blanks before a mark, as taken-out marks leave them."""
    return F.regexp_replace(F.regexp_replace(text, r"(?<=\S)[ \t]{2,}(?=\S)", " "), r"(?<=\S)[ \t]+([.,;:!?])", "$1")


def _tidied(before: Column, after: Column) -> Column:
    return F.when(before == after, before).otherwise(tidy(after))


def _mark(ref: Column, refs: Column, label: Column) -> Column:
    return F.concat(F.lit("[[cite:"), ref, F.lit(":"), refs, F.lit("|"), label, F.lit("]]"))


def _salvaged(mark: Column, known: Column) -> Column:
    """A mark that names several chunks or has junk in it, as one mark for each chunk that there is."""
    label = F.coalesce(F.nullif(F.trim(F.regexp_extract(mark, LOOSE, 2)), F.lit("")), F.lit("source"))
    tokens = F.filter(F.split(F.regexp_extract(mark, LOOSE, 1), r"[:#,;\s]+"), lambda t: t != "")
    none = F.array().cast("array<struct<ref:string,refs:array<string>>>")
    empty = F.array().cast("array<string>")

    def add(groups: Column, t: Column) -> Column:
        last = F.try_element_at(groups, F.lit(-1))
        longer = F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(F.struct(last["ref"].alias("ref"), F.array_append(last["refs"], F.upper(t)).alias("refs"))))
        new = F.array_append(groups, F.struct(t.alias("ref"), empty.alias("refs")))
        return F.when(t.rlike(SENTENCE), F.when(F.size(groups) > 0, longer).otherwise(groups)).when(t.rlike(ALIAS) | t.rlike(LIKE_ID), new).otherwise(groups)

    groups = F.aggregate(tokens, none, add)
    real = F.filter(groups, lambda g: ~(g["ref"].rlike(ALIAS) & (F.size(known) > 0) & ~F.coalesce(F.map_contains_key(known, F.upper(g["ref"])), F.lit(False))))
    parts = F.transform(real, lambda g: _mark(g["ref"], F.when(F.size(g["refs"]) > 0, F.array_join(g["refs"], ",")).otherwise(F.lit("S1")), label))
    return F.when(mark.rlike(f"^{STRICT}$".replace("^(?i)", "(?i)^")), mark).otherwise(F.array_join(parts, ""))


def normalised(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Answers whose references, as ``[CHUNK C0 | file]``, ``(Chunk C0, Sentence S1)``, ``(C0, C2)`` or marks with several chunks, are marks of one chunk each with its id.

    What names chunks that weren't given is left out of marks with several, and stays as it is elsewhere.
    """
    given = retrieved.where("alias is not null and chunk_id is not null").groupBy("answer_id", F.upper("alias").alias("alias")).agg(F.max(F.struct("chunk_id", F.coalesce("filename", F.lit("source")).alias("file"))).alias("to"))
    maps = given.groupBy("answer_id").agg(F.map_from_entries(F.collect_list(F.struct("alias", "to"))).alias("_known"))  # what one answer was given
    rows = answers.join(maps, "answer_id", "left").withColumn("_known", F.coalesce("_known", F.create_map().cast("map<string,struct<chunk_id:string,file:string>>")))
    known = F.col("_known")
    to = lambda a: F.element_at(known, F.upper(a))
    steps = []
    steps.append(lambda c: each_match(c, RAW, lambda x: _mark(F.regexp_extract(x, RAW, 1), F.lit("S1"), F.coalesce(F.nullif(F.trim(F.regexp_extract(x, RAW, 2)), F.lit("")), F.lit("source")))))
    steps.append(lambda c: each_match(c, IN_WORDS, lambda x: _mark(F.regexp_extract(x, IN_WORDS, 1), F.array_join(F.transform(matches(F.regexp_extract(x, IN_WORDS, 2), r"(?i)S\d+"), lambda s: F.upper(s)), ","), F.lit("source"))))

    def bare(x: Column) -> Column:
        names = matches(x, r"C\d+")
        all_known = F.forall(names, lambda a: F.coalesce(F.map_contains_key(known, a), F.lit(False)))
        return F.when(all_known, F.array_join(F.transform(names, lambda a: _mark(to(a)["chunk_id"], F.lit("S1"), to(a)["file"])), "")).otherwise(x)

    steps.append(lambda c: each_match(c, BARE, bare))
    steps.append(lambda c: _tidied(c, each_match(c, LOOSE, lambda x: _salvaged(x, known))))

    def resolve(x: Column) -> Column:
        ref, refs, label = F.regexp_extract(x, STRICT, 1), F.regexp_extract(x, STRICT, 2), F.nullif(F.regexp_extract(x, STRICT, 3), F.lit(""))
        hit = to(ref)
        return F.when(ref.rlike(ALIAS) & hit.isNotNull(), _mark(hit["chunk_id"], refs, F.coalesce(label, hit["file"]))).otherwise(x)

    steps.append(lambda c: each_match(c, LOOSE, resolve))
    for n, step in enumerate(steps):  # a column each, so that no step is evaluated more than once
        rows = rows.withColumn(f"_text{n}", F.coalesce(step(F.col("text" if not n else f"_text{n - 1}")), F.lit("")))
    return rows.select("answer_id", F.col(f"_text{len(steps) - 1}").alias("text"))


def without_malformed(answers: DataFrame) -> DataFrame:
    """Answers without marks that can't be read or whose chunk is still an alias."""
    keep = lambda x: F.when((F.regexp_extract(x, STRICT, 0) == x) & ~F.regexp_extract(x, STRICT, 1).rlike(ALIAS), x).otherwise("")
    return answers.withColumn("_left", each_match(F.col("text"), LOOSE, keep)).select("answer_id", _tidied(F.col("text"), F.col("_left")).alias("text"))


def _found(quotes: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(answer_id, n, place, to): of the quotations ``quotes`` (answer_id, n, place, quote) that a chunk holds, the earliest such chunk of the document and the sentence they start in."""
    keyed = quotes.withColumn("_key", F.trim(F.left("quote", F.lit(KEY_CHARS))))
    met = keyed.join(retrieved.where("content <> ''"), "answer_id").where((F.col("_key") != "") & F.contains("content", F.col("_key")))
    at = F.call_function("locate", F.col("_key"), F.col("content")) - 1
    hit = F.array_position(F.transform(F.coalesce("sentence_offsets", F.array().cast("array<struct<start:int,end:int>>")), lambda o: (o["start"] <= at) & (at < o["end"])), F.lit(True))
    sentence = F.concat(F.lit("S"), F.greatest(hit, F.lit(1)))
    return met.groupBy("answer_id", "n", "place").agg(F.min(F.struct(F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), "chunk_id", sentence.alias("sentence"), F.coalesce("filename", F.lit("source")).alias("file"))).alias("to"))


def _rebuilt(answers: DataFrame, changed: DataFrame, blocks: bool) -> DataFrame:
    """Answers with the n-th block, or else paragraph, as ``changed`` (answer_id, n, new) has it."""
    maps = changed.where("new is not null").groupBy("answer_id").agg(F.map_from_entries(F.collect_list(F.struct("n", "new"))).alias("_new"))  # parts of one answer
    pattern = BLOCK if blocks else BLANK_LINE
    rows = answers.join(maps, "answer_id", "left").withColumns({"_between": F.split("text", pattern), "_found": matches("text", pattern)})
    parts, gaps = ("_found", "_between") if blocks else ("_between", "_found")
    new = F.transform(parts, lambda x, i: F.coalesce(F.element_at("_new", i), x))
    pairs = F.zip_with(gaps, new, lambda g, x: F.concat(F.coalesce(g, F.lit("")), F.coalesce(x, F.lit("")))) if blocks else F.zip_with(new, gaps, lambda x, g: F.concat(F.coalesce(x, F.lit("")), F.coalesce(g, F.lit(""))))
    return rows.select("answer_id", F.when(F.col("_new").isNull(), F.col("text")).otherwise(F.array_join(pairs, "")).alias("text"))


def _blocks(answers: DataFrame) -> DataFrame:
    """(answer_id, n, block, plain, following): runs of quoted lines, their words without marks, and the line after them."""
    each = answers.select("answer_id", F.split("text", BLOCK).alias("_pieces"), F.posexplode(matches("text", BLOCK)).alias("n", "block"))
    strip = lambda line: F.regexp_replace(F.trim(F.regexp_replace(F.trim(F.regexp_replace(line, r"^>\s*", "")), r"\[\[cite:[^\]]+\]\]", "")), '^["“”]+|["“”]+$', "")
    plain = F.array_join(F.filter(F.transform(F.split("block", "\n"), strip), lambda x: x != ""), " ")
    return each.select("answer_id", "n", "block", plain.alias("plain"), F.coalesce(F.get(F.split(F.get("_pieces", F.col("n") + 1), "\n"), F.lit(1)), F.lit("")).alias("following"))


def corrected(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Answers whose quoted blocks cite a chunk that doesn't hold them, with the last mark of such a block turned to one that does. Blocks under 40 characters stay."""
    blocks = _blocks(answers).where(F.col("block").contains("[[cite:") & (F.length("plain") >= LEAST_BLOCK)).withColumn("mark", F.try_element_at(matches("block", STRICT), F.lit(-1))).where("mark is not null")
    blocks = blocks.withColumn("cited", F.regexp_extract("mark", STRICT, 1))
    own = retrieved.select("answer_id", F.col("chunk_id").alias("cited"), F.col("content").alias("_cited"))
    wrong = blocks.join(own, ["answer_id", "cited"], "left").groupBy("answer_id", "n", "block", "plain", "mark", "cited").agg(F.max(F.coalesce(F.contains("_cited", F.trim(F.left("plain", F.lit(KEY_CHARS)))), F.lit(False))).alias("right")).where("not right")
    to = _found(wrong.select("answer_id", "n", F.lit(0).alias("place"), F.col("plain").alias("quote")), retrieved)
    met = wrong.join(to, ["answer_id", "n"]).where(F.col("to.chunk_id") != F.col("cited"))
    at = F.call_function("locate", F.col("mark"), F.col("block"))
    new = F.concat(F.substring("block", F.lit(1), at - 1), _mark(F.col("to.chunk_id"), F.col("to.sentence"), F.col("to.file")), F.substring("block", at + F.length("mark"), F.length("block")))
    return _rebuilt(answers, met.select("answer_id", "n", new.alias("new")), True)


def blocks_cited(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Answers with a mark behind each quoted block of 40 characters or more that has none, nor the line after it, and that a chunk holds."""
    bare = _blocks(answers).where(~F.col("block").contains("[[cite:") & ~F.col("following").contains("[[cite:") & (F.length("plain") >= LEAST_BLOCK))
    to = _found(bare.select("answer_id", "n", F.lit(0).alias("place"), F.col("plain").alias("quote")), retrieved)
    met = bare.join(to, ["answer_id", "n"])
    return _rebuilt(answers, met.select("answer_id", "n", F.concat("block", F.lit(" "), _mark(F.col("to.chunk_id"), F.col("to.sentence"), F.col("to.file"))).alias("new")), True)


def _paragraphs(answers: DataFrame) -> DataFrame:
    """(answer_id, n, paragraph): what blank lines part."""
    return answers.select("answer_id", F.posexplode(F.split("text", BLANK_LINE)).alias("n", "paragraph"))


def _candidates(span: Column) -> Column:
    """A quotation as it stands, without marks at its ends, and its longest run of words."""
    trimmed = F.regexp_replace(span, r"^[\s.,;:!?]+|[\s.,;:!?]+$", "")
    runs = matches(span, r"[\p{L}\p{N}_' ]+")
    longest = F.trim(F.aggregate(runs, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a)))
    return F.array_distinct(F.filter(F.array(span, trimmed, longest), lambda c: c != ""))


def _with_mark(paragraph: Column, marks: Column) -> Column:
    """Before the mark that ends a paragraph, and white space behind it."""
    body = F.regexp_replace(paragraph, r"\s+$", "")
    rest = F.substring(paragraph, F.length(body) + 1, F.length(paragraph))
    ends = F.right(body, F.lit(1)).isin(".", ";", ",", "!", "?")
    return F.concat(F.when(ends, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body), F.lit(" "), marks, F.when(ends, F.right(body, F.lit(1))).otherwise(""), rest)


def paragraphs_cited(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Answers with a mark at the end of each paragraph that has none and quotes a chunk: the first of its quotations that one holds counts. Quoted blocks are left alone."""
    own = _paragraphs(answers).where(~F.col("paragraph").contains("[[cite:") & F.exists(F.split("paragraph", "\n"), lambda x: ~(F.trim(x).startswith(">") | (F.trim(x) == ""))))
    spans = F.filter(F.transform(matches("paragraph", SPAN, 1), lambda s: F.trim(s)), lambda s: s != "")
    asked = own.select("answer_id", "n", F.posexplode(F.flatten(F.transform(spans, _candidates))).alias("place", "quote")).where(F.length("quote") >= LEAST_SPAN)
    first = _found(asked, retrieved).groupBy("answer_id", "n").agg(F.min_by("to", "place").alias("to"))
    met = own.join(first, ["answer_id", "n"])
    return _rebuilt(answers, met.select("answer_id", "n", _with_mark(F.col("paragraph"), _mark(F.col("to.chunk_id"), F.col("to.sentence"), F.col("to.file"))).alias("new")), False)


def relocated(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Answers whose marks stand at the earliest paragraph that quotes their chunk; marks that no paragraph quotes stay, paragraphs of marks alone that all went are gone."""
    own = materialise(_paragraphs(answers), "paragraphs")
    marks = own.select("answer_id", "n", F.posexplode(matches("paragraph", STRICT)).alias("place", "mark")).withColumn("chunk_id", F.regexp_extract("mark", STRICT, 1))
    prose = own.where(F.trim(F.regexp_replace("paragraph", LOOSE, "")) != "")
    quotes = prose.select("answer_id", F.col("n").alias("home"), F.explode(F.flatten(F.transform(matches("paragraph", SHORT_SPAN, 1), lambda s: _candidates(F.trim(s))))).alias("quote")).where(F.length("quote") >= LEAST_MOVE)
    cited = retrieved.join(marks.select("answer_id", "chunk_id").distinct(), ["answer_id", "chunk_id"], "left_semi").select("answer_id", "chunk_id", F.lower("content").alias("_content"))
    homes = quotes.join(cited, "answer_id").where(F.contains("_content", F.lower("quote"))).groupBy("answer_id", "chunk_id").agg(F.min("home").alias("home"))
    moved = marks.join(homes, ["answer_id", "chunk_id"]).where("home <> n")
    gone = moved.groupBy("answer_id", "n").agg(F.collect_list("mark").alias("_gone"))
    come = moved.groupBy("answer_id", F.col("home").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "place", "mark"))), lambda x: x["mark"]), " ").alias("_come"))
    left = own.join(gone, ["answer_id", "n"], "left").join(come, ["answer_id", "n"], "left")
    first_out = lambda t, k: F.when(F.call_function("locate", k, t) > 0, F.concat(F.substring(t, F.lit(1), F.call_function("locate", k, t) - 1), F.substring(t, F.call_function("locate", k, t) + F.length(k), F.length(t)))).otherwise(t)
    left = left.withColumn("_left", F.aggregate(F.coalesce("_gone", F.array().cast("array<string>")), F.col("paragraph"), first_out))
    new = F.when(F.col("_come").isNotNull(), _with_mark(F.regexp_replace("_left", r"\s+$", ""), F.col("_come"))).otherwise(F.col("_left"))
    parts = left.withColumn("new", new).where(F.trim("new") != "").groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("n", "new"))).alias("parts"))
    whole = tidy(F.array_join(F.transform("parts", lambda p: p["new"]), "\n\n"))
    touched = moved.select("answer_id").distinct().withColumn("_moved", F.lit(True))
    out = answers.join(touched, "answer_id", "left").join(parts, "answer_id", "left")
    return out.select("answer_id", F.when(F.col("_moved"), F.coalesce(whole, F.lit(""))).otherwise(F.col("text")).alias("text"))


def repaired(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """All repairs in their order; each step's answers are written, so the next one reads them once."""
    rows = materialise(normalised(answers, retrieved), "answers")
    for step in (corrected, relocated, blocks_cited, paragraphs_cited):
        rows = materialise(step(rows, retrieved), "answers")
    return without_malformed(rows)


# ---- queries -------------------------------------------------------------------------------


def _retrieved(spark, d) -> DataFrame:
    """Three stretches of each document as its answer's chunks, each of three sentences."""
    docs = m.table(spark, d, "documents").where(F.length("text") >= 400).select("doc_id", F.regexp_replace("text", r"[\s\"“”«»>\[\]|]+", " ").alias("text"))
    k = F.col("k")
    offsets = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 40), (40, 80), (80, 120))])
    return docs.where(F.length("text") >= 360).select("doc_id", "text", F.explode(F.array(*map(F.lit, range(3)))).alias("k")).select(
        F.col("doc_id").alias("answer_id"), F.concat(F.lit("C"), k).alias("alias"), F.concat(F.lit("chunk_"), F.left(F.md5(F.concat("doc_id", F.lit(":"), k)), F.lit(12))).alias("chunk_id"), k.alias("chunk_index"),
        F.concat(F.lit("f"), F.col("doc_id") % 5).alias("filename"), F.substring("text", k * 120 + 1, F.lit(120)).alias("content"), offsets.alias("sentence_offsets"),
    )


def _answers(given: DataFrame) -> DataFrame:
    """Answers with marks as models write them, one kind for each document of ``given`` in turn."""
    c = given.groupBy("answer_id").agg(*[F.max(F.when(F.col("chunk_index") == k, F.struct("chunk_id", "content"))).alias(f"c{k}") for k in range(3)])
    quote = lambda k, at=1, n=60: F.substring(F.col(f"c{k}.content"), at, n)
    lit = F.lit
    kinds = [
        F.concat(lit("Seen [CHUNK C1 | my file] and (Chunk c2, Sentences S1, s3) or (C0, C2) but (C0, C9).")),
        F.concat(lit("It is so [[cite:C0:S2,C1;S4,O5,C7|lab]] and so [[cite:C9]]  there [[cite:zz:S1]] .")),
        F.concat(lit("> "), quote(1, 1, 70), lit(" [[cite:C0:S1|x]]\nAfter it.")),
        F.concat(lit('Said:\n> "'), quote(2, 1, 80), lit('"\n\nNothing more.')),
        F.concat(lit('It says "'), quote(1, 41, 30), lit('." indeed.\n\nNo quote here.')),
        F.concat(lit('First "'), quote(0, 5, 30), lit('" holds.\n\nThen "'), quote(2, 5, 30), lit('" too.\n\n[[cite:C2:S1|b]]\n\nEnd [[cite:C0:S1|a]]')),
    ]
    at = F.col("answer_id") % len(kinds)
    text = lit(None).cast("string")
    for k, kind in enumerate(kinds):
        text = F.when(at == k, kind).otherwise(text)
    return c.select("answer_id", text.alias("text"))


@query("citation_family")
def citation_family(spark, d):
    """Six kinds of broken answers, each repaired; tested against what each must become."""
    given = materialise(_retrieved(spark, d), "retrieved")  # a few hundred characters a document, which every repair reads
    return repaired(_answers(given), given)
