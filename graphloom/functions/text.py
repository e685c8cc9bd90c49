"""Text cleaning, splitting, scoring and parsing as columns.

Patterns name their character classes, so that Java's and RE2's engines read them alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The spaces of Unicode other than the blank.
SPACES = "   -   　"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def estimate_tokens(text: Column | str, per: int = 4) -> Column:
    """Tokens by length: 0 for nothing, else one at least."""
    n = F.length(_c(text))
    return F.when(n.isNull() | (n == 0), 0).otherwise(F.greatest(F.lit(1), F.floor(n / per).cast("int")))


def strip_controls(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]", "")


def strip_bom(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), "^\\x{FEFF}", "")


def tidy_spaces(text: Column | str) -> Column:
    """Unicode spaces to blanks, line ends to newlines, runs to one, no blanks at line ends, two newlines at most."""
    out = F.regexp_replace(_c(text), f"[{SPACES}]", " ")
    for pattern, by in (("\r\n?", "\n"), ("[ \t\f\x0b]+", " "), (" +\n", "\n"), ("\n{3,}", "\n\n"), (r"^[ \n]+|[ \n]+$", "")):
        out = F.regexp_replace(out, pattern, by)
    return out


def web_basic(html: Column | str) -> Column:
    """Text of a page: unseen and framing elements go, blocks become lines, tags go, entities are read."""
    out = _c(html)
    for tag in ("script", "style", "nav", "footer", "header", "aside"):
        out = F.regexp_replace(out, f"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    out = F.regexp_replace(out, "(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr)[^>]*>", "\n")
    out = F.regexp_replace(out, "(?s)<[^>]+>", "")
    # Entities, the ampersand last.
    for entity, by in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(by))
    out = F.regexp_replace(out, "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(out, "\n[ \n]*\n", "\n\n"), r"^[ \n]+|[ \n]+$", "")


def looks_like_html(text: Column | str, window: int = 1000) -> Column:
    head = F.substring(_c(text), 1, window)
    patterns = ("(?i)<!doctype html", "(?i)<html[ >]", "(?i)<head[ >]", "(?i)<body[ >]", "(?i)<div[ >]", "(?i)<p[ >]", "(?i)<script[ >]")
    found = F.lit(False)
    for p in patterns:
        found = found | head.rlike(p)
    return found


def content_type(text: Column | str) -> Column:
    """html, json, csv, markdown, code or text, the first that fits."""
    t = F.trim(_c(text))
    lines = F.slice(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""), 1, 5)
    commas = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(","), F.lit(""))))
    csv = (F.size(lines) >= 2) & (F.element_at(commas, 1) > 0) & (F.array_min(commas) == F.array_max(commas))
    return (
        F.when(looks_like_html(t), "html")
        .when(t.rlike(r"^[\[{]") & t.rlike(r"[\]}]$"), "json")
        .when(F.coalesce(csv, F.lit(False)), "csv")
        .when(t.rlike(r"(?m)^#{1,6} |^[*-] |^```"), "markdown")
        .when(t.rlike(r"(?m)^(def|class|import|function|public|#include)[ (]"), "code")
        .otherwise("text")
    )


def structure_score(text: Column | str) -> Column:
    """0.5 and more for headers, lists, paragraphs, fences, tables; 1 at most."""
    t = _c(text)
    mark = lambda p, v: F.when(t.rlike(p), v).otherwise(0.0)
    return F.least(F.lit(1.0), 0.5 + mark(r"(?m)^#{1,6} ", 0.15) + mark(r"(?m)^([*-]|[0-9]+\.) ", 0.1) + mark("\n\n", 0.1) + mark("```", 0.1) + mark(r"(?m)^\|.*\|", 0.05))


# Frequent English words.
COMMON = ("the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my one all").split()


def language_confidence(text: Column | str) -> Column:
    """From the mean word length and the share of frequent words; 0.3 without words."""
    words = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[\p{L}]+"), F.lit(0))
    n = F.size(words)
    length = F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)) / n
    share = F.size(F.filter(words, lambda w: w.isin(*COMMON))) / n
    return F.when(n == 0, 0.3).otherwise(F.least(F.lit(1.0), 0.3 + F.when(length.between(3, 8), 0.3).otherwise(0.1) + F.least(F.lit(0.4), share)))


def text_ratio(text: Column | str) -> Column:
    n = F.length(_c(text))
    return F.when(n == 0, 0.0).otherwise(F.round(F.length(F.regexp_replace(_c(text), r"[^\p{L}]", "")) / n, 3))


def length_reduction(before: Column | str, after: Column | str) -> Column:
    a, b = F.length(_c(before)), F.length(_c(after))
    return F.when(a == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - b / a), 3))


def alpha_ratio(text: Column | str) -> Column:
    """Letters among letters, digits and blanks."""
    n = F.length(F.regexp_replace(_c(text), r"[^\p{L}\p{N} ]", ""))
    return F.when(n == 0, 0.0).otherwise(F.round(F.length(F.regexp_replace(_c(text), r"[^\p{L}]", "")) / n, 4))


def is_gibberish(text: Column | str) -> Column:
    """Over 30 % of words hold five consonants in a row."""
    words = F.filter(F.split(F.lower(_c(text)), " "), lambda w: w != "")
    odd = F.filter(words, lambda w: w.rlike("[bcdfghjklmnpqrstvwxz]{5}"))
    return (F.size(words) > 0) & (F.size(odd) / F.size(words) > 0.3)


# Short lines of scans that always stay, that never do, and shapes of noise.
KEPT_WORDS = (
    "by", "to", "for", "from", "with", "the", "a", "an", "and", "or", "but", "nor", "yet", "so", "as", "if", "no", "vs", "re", "ch", "pt", "vol", "ed", "rev",
    "in", "on", "at", "of", "up", "out", "off", "is", "it", "be", "we", "he", "me", "my", "do", "go", "am", "us", "oh", "ok", "id",
)
SCAN_NOISE = ("i", "l", "1", "|", "ii", "ll", "il", "li", "hi", "ih", "ie", "ei", "fi", "ti", "ri", "ir", "f", "t", "r", "n", "m")
NOISE_SHAPES = r"(?i)^[a-z]\s+[a-z]$|^([a-z]\s+){2,}[a-z]?$"
ROMAN = r"(?i)^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
STRUCTURAL_LINE = r"^#{1,6}\s+\S|^[-*+•]\s*\S|^[0-9]+[.)]\s*\S|^[-_=*]{3,}$"
SHORT_LINE, LEAST_LETTERS = 5, 0.5


def keeps_line(line: Column, known: Column | None = None, short: int = SHORT_LINE, least: float = LEAST_LETTERS) -> Column:
    """Whether a line of a scan is text.

    Blank lines stay. Of lines under ``short`` characters noise goes; marks of structure, common words and Roman numerals stay; of the others those whose word is ``known`` to a
    dictionary, or all without one, but lines without a word go. Longer ones go if under ``least`` of their letters, figures and blanks are letters, if over 30 % of them are in runs
    of five consonants, or if capitals alternate in most words.
    """
    t = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    word = F.lower(F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", "")))
    repeated = t.rlike(r"^(.)\1+$") & ~F.left(t, F.lit(1)).rlike("(?i)[ivxlcdm]")
    noise = word.isin(*SCAN_NOISE) | t.rlike(NOISE_SHAPES) | repeated
    stays = t.rlike(STRUCTURAL_LINE) | word.isin(*KEPT_WORDS) | t.rlike(ROMAN)
    of_short = F.when(noise, False).when(stays, True).when(word == "", False).otherwise(F.lit(True) if known is None else known)
    letters, counted = F.length(F.regexp_replace(t, r"[^\p{L}]", "")), F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\s]", ""))
    clusters = F.length(t) - F.length(F.regexp_replace(t, "(?i)[bcdfghjklmnpqrstvwxyz]{5,}", ""))
    words = F.split(t, r"\s+")
    odd = F.size(F.filter(words, lambda w: w.rlike("^[A-Z][a-z][A-Z]")))
    gibberish = (F.length(t) >= 10) & ((clusters / F.length(t) > 0.3) | (t.rlike("([A-Z][a-z]){4,}|([a-z][A-Z]){4,}") & (odd > F.size(words) * 0.5)))
    of_long = (counted > 0) & (letters / F.greatest(counted, F.lit(1)) >= least) & ~gibberish
    return F.when(t == "", True).when(F.length(t) < short, of_short).otherwise(of_long)


def numbered_sentences(sentences: Column) -> Column:
    return F.array_join(F.transform(sentences, lambda s, i: F.concat(F.lit("S"), i + 1, F.lit(": "), s)), "\n")


def plain_sentences(text: Column | str) -> Column:
    """Split after . ! ? before a capital; abbreviations aren't known here, see ``split_sentences``."""
    marked = F.regexp_replace(_c(text), r"([.!?])[ \n\t]+(\p{Lu})", "$1\u0001$2")
    return F.split(marked, "\u0001")


# Abbreviations that end no sentence.
ABBREVIATIONS = (
    "Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "St", "Gen", "Gov", "Rep", "Sen", "Sgt", "Cpl", "Pvt", "Capt", "Lt", "Col", "Maj", "Cmdr", "Adm", "Rev", "Hon", "Pres", "U.S", "U.K", "E.U", "U.N",
    "a.m", "p.m", "vs", "etc", "i.e", "e.g", "al", "fig", "no", "vol", "dept", "approx", "inc", "ltd", "corp", "assn",
)


def sentence_offsets(value: str | None) -> list[dict[str, int]]:
    """Start and end of each sentence, without the blanks around it; none of a blank text.

    A sentence ends at a mark before white space and a capital, a quotation mark or a bracket, unless the mark ends an abbreviation or
    both lie inside one pair of quotation marks.
    """
    if not value or not value.strip():
        return []
    quoted = [m.span() for m in _QUOTED.finditer(value)]
    spans, at, k = [], 0, 0
    for m in _BORDER.finditer(value):
        while k < len(quoted) and quoted[k][1] <= m.start():
            k += 1
        inside = k < len(quoted) and quoted[k][0] < m.start()
        if inside or _SHORT.search(value, max(0, m.start() - 8), m.start()):
            continue
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(value)))
    out = []
    for start, end in spans:
        part = value[start:end]
        if part.strip():
            lead = len(part) - len(part.lstrip())
            out.append({"start": start + lead, "end": start + lead + len(part.strip())})
    return out


_BORDER = re.compile(r"(?<=[.!?])\s+(?=[A-Z\u201c\"(])")
_QUOTED = re.compile("[\"\u201c][^\"\u201c\u201d]*[\"\u201d]")
_SHORT = re.compile(r"\b(?:" + "|".join(re.escape(a) for a in sorted(ABBREVIATIONS, key=len, reverse=True)) + r")\.$")


def split_sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add sentences array<struct<start,end>>: see :func:`sentence_offsets`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(sentences=frame[text].map(sentence_offsets))

    schema = ", ".join(f"`{n}` {k}" for n, k in docs.dtypes) + ", sentences array<struct<start:int,end:int>>"
    return docs.mapInPandas(run, schema)


def sentence_refs(ref: Column | str, n: Column) -> Column:
    """Numbers that S1, S1-S3 and lists of them name, ascending; null if any is out of 1..n or nothing fits."""
    parts = F.filter(F.split(F.upper(F.regexp_replace(_c(ref), "[ \t]", "")), "[,;]"), lambda p: p != "")
    low = lambda p: F.regexp_extract(p, "^S([0-9]+)", 1).try_cast("int")
    high = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, "^S[0-9]+-S?([0-9]+)$", 1), F.lit("")).try_cast("int"), low(p))
    fine = (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike("^S[0-9]+(-S?[0-9]+)?$") & (low(p) >= 1) & (high(p) >= low(p)) & (high(p) <= n))
    return F.when(F.coalesce(fine, F.lit(False)), F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(low(p), high(p)))))))


def edge_label(label: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(label))), "[ _\t\n]+", "_"), "^_+|_+$", "")


def safe_float(text: Column | str, default: float = 0.8) -> Column:
    """The first number in a text, held to 0..1."""
    found = F.regexp_extract(_c(text), r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.when(found.isNull(), default).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), found)))


def unescape_field(text: Column | str) -> Column:
    """Escaped bars read, markdown around the whole field taken off."""
    out = F.replace(F.trim(_c(text)), F.lit("\\|"), F.lit("|"))
    for _ in range(3):
        out = F.regexp_replace(out, r"^(\*\*|__|`|\*|_)(.*?)(\*\*|__|`|\*|_)$", "$2")
    return out


def embedding_text(name: Column, aliases: Column, description: Column, budget: int = 16_000) -> Column:
    known = F.when(F.size(aliases) > 0, F.concat(F.lit("Also known as: "), F.array_join(aliases, ", ")))
    return F.substring(F.concat_ws(" | ", name, known, F.nullif(description, F.lit(""))), 1, budget)


def parse_lines(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows (…, line_no, kind, fields, valid) of the bar-separated record lines in a text.

    E has seven fields, R seven, P four, A six; a trailing bar is ignored, bullets before the letter go, and
    what fits no kind is invalid.
    """
    lines = rows.select("*", F.posexplode(F.split(text, "\n")).alias("line_no", "_line")).where(F.trim("_line") != "")
    clean = F.regexp_replace(F.regexp_replace(F.trim("_line"), r"^[-*•] *", ""), r"\|$", "")
    lines = lines.withColumn("_line", clean)
    kind = F.upper(F.regexp_extract("_line", r"^([EeRrPpAa])\|", 1))
    need = F.when(kind.isin("E", "R"), 7).when(kind == "P", 4).when(kind == "A", 6)
    fields = F.split("_line", r"(?<!\\)\|", -1)
    return lines.select(*rows.columns, "line_no", F.when(need.isNotNull(), kind).alias("kind"), fields.alias("fields"), F.coalesce(F.size(fields) == need, F.lit(False)).alias("valid"))


def aliases_of(text: Column | str) -> Column:
    """Aliases in a field: parted by semicolons, else by commas; brackets, equations and empty words go."""
    t = F.trim(_c(text))
    parts = F.when(t.contains(";"), F.split(t, ";")).otherwise(F.split(t, ", "))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(r"[\[\]{}=]") & ~F.lower(p).isin("none", "null", "n/a", "unknown", "-")))


def citations_in(text: Column | str) -> Column:
    """array<struct<id,refs,label>> of [[cite:id:S1,S2|label]] marks."""
    pattern = r"\[\[cite:([A-Za-z0-9_-]+):([S0-9,\-]+)(?:\|([^\]]*))?\]\]"
    get = lambda k: F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(k))
    return F.transform(F.arrays_zip(get(1).alias("id"), get(2).alias("refs"), get(3).alias("label")), lambda x: F.struct(x["id"].alias("id"), x["refs"].alias("refs"), x["label"].alias("label")))


def normal_quote(text: Column | str) -> Column:
    """Dashes, quotes and spaces made alike for comparison."""
    out = F.translate(_c(text), "–—‘’“” ", "--''\"\" ")
    return F.lower(F.trim(F.regexp_replace(out, "[ \n\t]+", " ")))


def name_key(name: Column | str) -> Column:
    """Accents off (Latin letters), trimmed, lower case."""
    # Accented letters and what they become.
    return F.lower(F.trim(F.translate(_c(name), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")))


# Title words that don't tell names apart.
TITLES = ("mr", "mrs", "ms", "dr", "prof", "sir", "lady", "lord", "the")


def significant_words(name: Column | str) -> Column:
    words = F.split(F.regexp_replace(name_key(name), "[.,/ -]+", " "), " ")
    return F.filter(words, lambda w: ~w.isin(*TITLES) & (F.length(w) > 1))


def at_word_boundary(text: Column, part: Column) -> Column:
    """The first occurrence of ``part`` has no letter or digit beside it."""
    at = F.locate(part, text) if isinstance(part, str) else F.call_function("locate", part, text)
    before, after = F.substring(text, at - 1, F.lit(1)), F.substring(text, at + F.length(part), F.lit(1))
    return (at > 0) & ((at == 1) | ~before.rlike(r"[\p{L}\p{N}]")) & ~after.rlike(r"[\p{L}\p{N}]")


# Types that say nothing, so they go with any other.
GENERIC_TYPES = ("unknown", "thing", "entity", "item", "object", "concept", "")


def types_compatible(a: Column, b: Column, groups: dict[str, list[str]] | None = None) -> Column:
    """Equal types, a generic one, or two of one of the ``groups``; case and blanks around don't matter, null is empty."""
    x, y = F.lower(F.trim(F.coalesce(a, F.lit("")))), F.lower(F.trim(F.coalesce(b, F.lit(""))))
    fits = (x == y) | x.isin(*GENERIC_TYPES) | y.isin(*GENERIC_TYPES)
    for members in (groups or {}).values():
        low = sorted({t.lower() for t in members})
        fits = fits | (x.isin(*low) & y.isin(*low))
    return fits


def simhash(tokens: Column) -> Column:
    """64-bit fingerprint of an array of tokens, from the low half of their SHA-256: a bit is set if most have it."""
    one = F.lit(1).cast("bigint")
    hashes = F.transform(tokens, lambda t: F.conv(F.substring(F.sha2(t, 256), 49, 16), 16, -10).cast("bigint"))

    def fold(hashes: Column) -> Column:
        times = lambda i: F.size(F.filter(hashes, lambda h: F.call_function("shiftright", h, i).bitwiseAND(one) != 0))
        bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(2 * times(i) > F.size(hashes), F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))

    return F.transform(F.array(hashes), fold)[0]  # the hashes are worked out once
