"""Kinds of content that are taken out of chunks before extraction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Category:
    """``line_ratio`` drops the lines that match if they are a share of ``threshold`` or more of those not blank; ``count`` empties a text with so many matches."""

    mode: str
    pattern: str
    threshold: float


# The categories' patterns and thresholds.
CATEGORIES: dict[str, Category] = {
    "toc": Category("line_ratio", r"^\s*[-*•]\s+\S", 0.70),
    "changelog": Category("count", r"(?i)(?:changed|new|deprecated|added|removed) (?:in |since )(?:version |python )\d", 5),
    "legal": Category("count", r"(?i)copyright|permission is hereby granted|all rights reserved|without warranty|as[\- ]is|terms of (?:service|use)", 2),
    "bibliography": Category("count", r"(?im)^\s*\[\d{1,4}\]\s+|(?:references|bibliography|works\s+cited)\s*$", 3),
    "acknowledgments": Category("count", r"(?i)(?:thank|grateful|gratitude|acknowledge|dedication|indebted)", 3),
    "boilerplate": Category("count", r"(?m)^[\s]*[=\-~_*#]{3,}\s*$", 5),
    "metadata": Category("count", r"(?i)(?:last\s+(?:modified|updated|changed)|generated\s+(?:by|on)|revision\s+history|build:\s*v?\d)", 3),
    "code_blocks": Category("line_ratio", r"^\s{4,}\S|^\t\S|^```|^\s*(?:import |from |def |class |function |const |let |var |return |if |for |while )[a-zA-Z]", 0.75),
    "data_tables": Category("line_ratio", r"^\s*\|.*\|.*\||^\s*[-:]+\|[-:]+|^\s*[+][-]+[+]", 0.50),
    "math": Category("count", r"\$\$|\\begin\{(?:equation|align|gather)\}|\\frac|\\sum|\\int|\\partial|\\nabla", 3),
    "api_tables": Category("count", r"(?im)^\s*[1-5]\d{2}\s+(?:OK|Created|Accepted|Bad Request|Unauthorized|Forbidden|Not Found|Internal Server Error)|(?:parameters?|arguments?)\s*:\s*$", 3),
    "procedural": Category("count", r"(?im)^\s*\d+[.)]\s*(?:click|select|choose|open|navigate|install|download|run|restart|configure)\b", 5),
    "advertising": Category("count", r"(?i)subscribe|sign\s*up|try\s+(?:it\s+)?free|download\s+now|follow\s+us|affiliate|sponsored", 3),
    "web_artifacts": Category("count", r"(?i)we\s+use\s+cookies|cookie\s+(?:policy|settings|consent)|accept\s+(?:all\s+)?cookies|gdpr|by\s+(?:continuing|using).*agree", 2),
    "bulk_lists": Category("line_ratio", r"^\s*[-*+]\s+.{3,50}$", 0.85),
}
#: Characters below which a text counts as boilerplate, and below which a stripped chunk is left out.
LEAST = 100


def stripped(rows: DataFrame, names: list[str], text: str = "text", least: int = LEAST) -> DataFrame:
    """Add clean, categories (those that matched, in order) and excluded to rows: each category works on what the ones before it left.

    A chunk is excluded if something was taken out and fewer than ``least`` characters are left. Unknown names are an error; null text is empty.
    """
    if unknown := [n for n in names if n not in CATEGORIES]:
        raise ValueError(f"unknown categories: {', '.join(unknown)}; there are {', '.join(CATEGORIES)}")
    out = rows.withColumn("clean", F.coalesce(text, F.lit(""))).withColumn("categories", F.array().cast("array<string>"))
    for name in names:
        c = CATEGORIES[name]
        if c.mode == "count":
            hit = F.regexp_count("clean", F.lit(c.pattern)) >= c.threshold
            if name == "boilerplate":
                hit = hit | (F.length(F.trim("clean")) < LEAST)
            left: Column = F.lit("")
        else:
            lines = F.filter(F.split("clean", "\n"), lambda x: F.length(F.trim(x)) > 0)
            like = F.filter(lines, _matches(c.pattern))
            hit = (F.size(lines) > 0) & (F.size(like) / F.size(lines) >= c.threshold)
            left = F.array_join(F.filter(F.split("clean", "\n"), _misses(c.pattern)), "\n")
        out = out.withColumn("_hit", hit)
        out = out.withColumn("categories", F.when(F.col("_hit"), F.array_append("categories", F.lit(name))).otherwise(F.col("categories"))).withColumn("clean", F.when(F.col("_hit"), left).otherwise(F.col("clean"))).drop("_hit")
    short = (F.size("categories") > 0) & (F.length(F.trim("clean")) < least)
    return out.withColumn("excluded", short)


def _matches(pattern: str):
    return lambda line: line.rlike(pattern)


def _misses(pattern: str):
    return lambda line: ~((F.length(F.trim(line)) > 0) & line.rlike(pattern))
