"""Patterns that users write, matched with a limit of time that stops a match, and categories of content made of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The longest pattern in characters, and the seconds after which a match is given up.
LONGEST, SECONDS = 512, 0.1


class UserPattern:
    """A compiled pattern, case ignored and line by line; what isn't found in time isn't found, and is counted."""

    def __init__(self, pattern: str, seconds: float = SECONDS):
        if len(pattern) > LONGEST:
            raise ValueError(f"longer than {LONGEST} characters")
        self.source, self.seconds, self.timeouts = pattern, seconds, 0
        self._compiled = regex.compile(pattern, regex.IGNORECASE | regex.MULTILINE)

    def __reduce__(self):
        return UserPattern, (self.source, self.seconds)

    def search(self, text: str) -> bool:
        try:
            return self._compiled.search(text, timeout=self.seconds) is not None
        except TimeoutError:
            self.timeouts += 1
            return False

    def count(self, text: str) -> int:
        """Matches that don't overlap; none if they take too long."""
        try:
            return sum(1 for _ in self._compiled.finditer(text, timeout=self.seconds))
        except TimeoutError:
            self.timeouts += 1
            return 0


@dataclass
class Category:
    """A category of content: ``count`` matches in a text take all of it, a share of lines (``line_ratio``) takes these lines."""

    name: str
    pattern: UserPattern
    mode: str = "count"
    threshold: float = 1.0
    description: str = field(default="")


def compiled(specs: list[dict]) -> tuple[list[Category], list[dict]]:
    """(categories, errors): specs have regex, and maybe mode, threshold and description. One that isn't sound is left out and named, with its place, among the errors."""
    found, errors = [], []
    for k, spec in enumerate(specs):
        try:
            if not isinstance(spec.get("regex"), str):
                raise ValueError("no regex")
            if spec.get("mode", "count") not in ("count", "line_ratio"):
                raise ValueError(f"no mode {spec['mode']!r}")
            found.append(Category(f"custom_{k}", UserPattern(spec["regex"]), spec.get("mode", "count"), float(spec.get("threshold", 1)), spec.get("description", "")))
        except (ValueError, TypeError, regex.error) as e:
            errors.append({"index": k, "regex": str(spec.get("regex"))[:80], "error": str(e)})
    return found, errors


def strip_categories(rows: DataFrame, categories: list[Category], text: str = "text", least: int = 100) -> DataFrame:
    """Add clean, custom (names of the categories that matched), timeouts and excluded to rows, as the built-in categories do.

    Each category works on what those before it left; a text is excluded if something was taken and fewer than ``least`` characters are left. Null is empty. A match that
    is given up takes nothing and counts among the row's ``timeouts``.
    """
    added = ["clean", "custom", "timeouts"]
    base = rows.select(*[c for c in rows.columns if c not in added])
    schema = ", ".join([*(f"`{n}` {k}" for n, k in base.dtypes), "clean string, custom array<string>, timeouts int"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for value in frame[text]:
                value, names, before = value or "", [], sum(c.pattern.timeouts for c in categories)
                for c in categories:
                    if c.mode == "count":
                        hit, left = c.pattern.count(value) >= c.threshold, ""
                    else:
                        lines = value.split("\n")
                        like = [bool(x.strip()) and c.pattern.search(x) for x in lines]
                        full = sum(1 for x in lines if x.strip())
                        hit = full > 0 and sum(like) / full >= c.threshold
                        left = "\n".join(x for x, away in zip(lines, like, strict=True) if not away)
                    if hit:
                        names.append(c.name)
                        value = left
                out.append((value, names, sum(c.pattern.timeouts for c in categories) - before))
            clean, custom, timeouts = zip(*out, strict=True) if out else ((), (), ())
            yield frame.assign(clean=list(clean), custom=list(custom), timeouts=list(timeouts))

    done = base.mapInPandas(run, schema)
    return done.withColumn("excluded", (F.size("custom") > 0) & (F.length(F.trim("clean")) < least))
