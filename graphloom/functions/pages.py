"""What a page says, without what frames it: blocks of text, weighed by how much of them isn't links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements that are never part of a page's text, and those that start or end a block of it.
UNSEEN = ("head", "script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form")
BLOCKS = ("address", "article", "blockquote", "body", "br", "dd", "div", "dl", "dt", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul")
# Entities, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
# Media types besides text/* that are text.
TEXTUAL = ("application/json", "application/xml", "application/xhtml+xml", "application/javascript", "application/x-yaml", "application/yaml")

#: A block counts from so many characters outside links, averaged with its neighbours' (1, 2, 1), and up to this share of links.
LEAST_CHARS, MOST_LINKED = 40, 0.5

COMMENT = r"(?s)<!--.*?-->"
# a tag ends before another begins, so an open one isn't looked for to the end of the page
BLOCK = rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^<>]*>"
LINK = r"(?is)<a\b[^<>]*>(.*?)</a\s*>"
TITLE = r"(?is)<title\b[^<>]*>(.*?)</title\s*>"
TAG = r"<[^<>]+>"


def unseen(tag: str) -> str:
    return rf"(?is)<{tag}\b[^<>]*>.*?</{tag}\s*>"


def plain(part: Column) -> Column:
    """Text of a piece of a page: no tags, entities read, white space as one blank."""
    out = F.regexp_replace(part, TAG, "")
    for entity, by in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(by))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r\f\x0b]+", " "))


def main_text(pages: DataFrame, html: str = "html", least: int = LEAST_CHARS, most_linked: float = MOST_LINKED) -> DataFrame:
    """Add ``title`` and ``blocks``, the blocks that are a page's text, in order and each once.

    Blocks lie between tags of block elements. Each weighs its characters that aren't in links; a block stays if its weight and its neighbours', averaged, reach ``least``
    and links are ``most_linked`` of it at most, so a heading stays beside its paragraphs and a list of links goes. Null pages have no title and no blocks.
    """
    raw = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), COMMENT, "")
    body = raw
    for tag in UNSEEN:
        body = F.regexp_replace(body, unseen(tag), "")
    linked = lambda b: F.aggregate(F.regexp_extract_all(b, F.lit(LINK), F.lit(1)), F.lit(0), lambda s, a: s + F.length(plain(a)))
    each = F.transform(F.split(body, BLOCK), lambda b: F.struct(plain(b).alias("text"), linked(b).alias("linked")))
    weigh = F.transform(F.filter(each, lambda b: b["text"] != ""), lambda b: F.struct(b["text"].alias("text"), (F.length(b["text"]) - b["linked"]).alias("own")))
    # a column of its own: each block looks at its neighbours in it
    rows = pages.withColumn("title", plain(F.regexp_extract(raw, TITLE, 1))).withColumn("_blocks", weigh)
    at = lambda i: F.coalesce(F.get("_blocks", i)["own"], F.lit(0))
    stays = lambda b, i: (at(i - 1) + 2 * b["own"] + at(i + 1) >= 4 * least) & (b["own"] >= (1 - most_linked) * F.length(b["text"]))
    return rows.withColumn("blocks", F.array_distinct(F.transform(F.filter("_blocks", stays), lambda b: b["text"]))).drop("_blocks")


def host_of(url: Column) -> Column:
    """Host of an address of the web, lower case, without user and port; null for others."""
    host = F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]*)", 1))
    return F.when(host != "", host)


def safe_host(host: Column) -> Column:
    """Whether a host isn't this machine or one of a private network, by its name or number."""
    name = host.rlike(r"(^|\.)(localhost|local|internal)$")
    number = host.rlike(r"^[0-9.]+$") & (~host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | host.rlike(r"^(0|10|127|169\.254|192\.168|172\.(1[6-9]|2[0-9]|3[01]))\."))
    return host.isNotNull() & ~name & ~number & ~host.startswith("[")


def fetched(pages: DataFrame, url: str = "url", html: str = "html", media_type: str | None = None, allowed: tuple[str, ...] = ("*",)) -> DataFrame:
    """Add host, content_type, title, content and error to fetched pages.

    HTML is reduced to its main text, other text stays as it is, what isn't text has no content and is marked ``binary``. Pages of unsafe addresses and of types that aren't ``allowed``
    have an error and no content. ``media_type`` is a column with the type's header; without one what looks like HTML is.
    """
    from graphloom.functions.text import looks_like_html

    kind = F.lower(F.trim(F.split_part(F.coalesce(F.col(media_type), F.lit("")), F.lit(";"), F.lit(1)))) if media_type else F.when(looks_like_html(F.coalesce(F.col(html), F.lit(""))), "text/html").otherwise("text/plain")
    rows = main_text(pages, html).withColumns({"host": host_of(F.col(url)), "content_type": kind})
    textual = F.col("content_type").startswith("text/") | F.col("content_type").isin(*TEXTUAL)
    is_html = F.col("content_type") == "text/html"
    listed = F.lit(True) if "*" in allowed or not allowed else F.col("content_type").isin(*allowed)
    error = (
        F.when(F.coalesce(~safe_host(F.col("host")), F.lit(True)), "URL blocked by security policy").when(~listed, "content type not allowed")
        .when(is_html & (F.size("blocks") == 0), "Could not extract content")
    )
    rows = rows.withColumn("error", error)
    content = F.when(F.col("error").isNotNull() | ~textual, "").when(is_html, F.array_join("blocks", "\n")).otherwise(F.coalesce(F.col(html), F.lit("")))
    return rows.withColumns({"content": content, "binary": ~textual, "title": F.when(is_html & (F.col("error").isNull() | (F.col("error") == "Could not extract content")), F.col("title")).otherwise("")}).drop("blocks")
