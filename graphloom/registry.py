"""Plug-in registries: cleaners, loaders, tools. Later registrations of a name replace earlier ones."""

from __future__ import annotations

import importlib
import importlib.metadata
import inspect
import re
from collections.abc import Callable
from typing import Generic, TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as t
from graphloom.functions.user_patterns import UserPattern

T = TypeVar("T")


class Registry(Generic[T]):
    """Named plug-ins in order of priority; origins rank builtin, package, user, and a higher one wins."""

    ORIGINS = ("builtin", "package", "user")

    def __init__(self) -> None:
        self._held: dict[str, tuple[int, int, T]] = {}

    def register(self, name: str, plugin: T, priority: int = 100, origin: str = "builtin") -> None:
        rank = self.ORIGINS.index(origin)
        if name not in self._held or rank >= self._held[name][0]:
            self._held[name] = (rank, priority, plugin)

    def unregister(self, name: str) -> None:
        self._held.pop(name, None)

    def __getitem__(self, name: str) -> T:
        return self._held[name][2]

    def __len__(self) -> int:
        return len(self._held)

    def __iter__(self):
        return iter(p for _, _, p in sorted(self._held.values(), key=lambda x: x[1]))

    def discover(self, group: str) -> list[str]:
        """Register the entry points of ``group`` that installed packages declare; those that don't load are returned by name."""
        failed = []
        for point in importlib.metadata.entry_points(group=group):
            try:
                self.register(point.name, point.load(), origin="package")
            except Exception:  # whatever a foreign package does, the others load
                failed.append(point.name)
        return failed

    def reload(self, name: str) -> None:
        """Import a plug-in's module again and register what it defines under the same name there."""
        rank, priority, plugin = self._held[name]
        fresh = getattr(importlib.reload(importlib.import_module(plugin.__module__)), plugin.__qualname__)
        self._held[name] = (rank, priority, fresh)

    def names(self) -> list[str]:
        return sorted(self._held, key=lambda n: (self._held[n][1], n))


#: (applies, change): where the condition holds for a text, the change is made.
CLEANERS: Registry[tuple[Callable[[Column], Column], Callable[[Column], Column]]] = Registry()
CLEANERS.register("bom", (lambda c: c.startswith("﻿"), t.strip_bom), 10)
CLEANERS.register("web", (t.looks_like_html, t.web_basic), 20)
CLEANERS.register("controls", (lambda c: c.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]"), t.strip_controls), 30)
CLEANERS.register("spaces", (lambda c: F.lit(True), t.tidy_spaces), 40)

#: Steps of workflows: DataFrame and options to DataFrame.
TOOLS: Registry[Callable[..., DataFrame]] = Registry()


def _tool(name: str):
    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        TOOLS.register(name, f)
        return f

    return put


@_tool("data.filter")
def filter_rows(rows: DataFrame, where: str) -> DataFrame:
    """Rows for which a SQL condition holds."""
    return rows.where(where)


@_tool("data.extract")
def extract_path(rows: DataFrame, column: str, path: str, out: str) -> DataFrame:
    """Add what a dotted path finds in a column of JSON text; null where it finds nothing."""
    return rows.withColumn(out, F.get_json_object(column, "$." + re.sub(r"\.([0-9]+)(?=\.|$)", r"[\1]", path)))


@_tool("data.merge")
def merge_rows(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows with the columns of another result; of columns in both the other's value counts, where it has one."""
    theirs = other.select(*on, *[F.col(c).alias(f"_other_{c}") for c in other.columns if c not in on])
    joined = rows.join(theirs, on, "left")
    both = [c for c in rows.columns if c not in on and c in other.columns]
    new = [c for c in other.columns if c not in rows.columns]
    kept = [F.coalesce(f"_other_{c}", c).alias(c) if c in both else F.col(c) for c in rows.columns]
    return joined.select(*kept, *[F.col(f"_other_{c}").alias(c) for c in new])


@_tool("data.aggregate")
def aggregate_rows(rows: DataFrame, by: list[str], values: dict[str, str]) -> DataFrame:
    """Groups with SQL aggregates: values are names and expressions."""
    return rows.groupBy(*by).agg(*[F.expr(e).alias(n) for n, e in values.items()])


@_tool("data.sort")
def sort_rows(rows: DataFrame, by: list[str], limit: int | None = None) -> DataFrame:
    """Rows in the order of SQL expressions, the first ``limit`` of them."""
    ordered = rows.orderBy(*[F.expr(b[1:]).desc() if b.startswith("-") else F.expr(b) for b in by])
    return ordered if limit is None else ordered.limit(limit)


@_tool("logic.conditional")
def conditional(rows: DataFrame, when: str, then: str, otherwise: str, out: str) -> DataFrame:
    """Add one of two SQL expressions by a SQL condition; a null condition is false."""
    return rows.withColumn(out, F.when(F.coalesce(F.expr(when), F.lit(False)), F.expr(then)).otherwise(F.expr(otherwise)))


@_tool("logic.loop")
def loop(rows: DataFrame, array: str, out: str) -> DataFrame:
    """A row per element of an array column, with its place from 0; rows with an empty array go."""
    return rows.select("*", F.posexplode(array).alias(f"{out}_index", out))


@_tool("text.clean")
def clean_text(rows: DataFrame, text: str = "text") -> DataFrame:
    """All cleaners in order."""
    return clean(rows, text, text)


@_tool("text.match")
def match_text(rows: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """Whether a user's pattern is found, false where that takes too long; null texts have no answer."""
    own = UserPattern(pattern)

    @F.pandas_udf("boolean")
    def found(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else own.search(v))

    return rows.withColumn(out, found(text))


@_tool("ai.generate_embedding")
def generate_embedding(rows: DataFrame, text: str, out: str, embed: Callable[[Column], Column]) -> DataFrame:
    """Add the vectors of texts, by an injected column function."""
    return rows.withColumn(out, embed(F.col(text)))


@_tool("ai.vector_search")
def vector_search(rows: DataFrame, path: str, key: str, vector: str, k: int = 10, exact: bool = False) -> DataFrame:
    """(query_id, id, score): the nearest ``k`` of a stored index for each row's vector."""
    from graphloom.operators.vector_index import search_many

    return search_many(rows.select(F.col(key).alias("query_id"), F.col(vector).alias("embedding")), path, k, exact=exact)


@_tool("ai.prompt")
def prompt(rows: DataFrame, template: str, out: str, ask: Callable[[Column], Column]) -> DataFrame:
    """Add a model's answers, by an injected column function, to a prompt in which ``{column}`` stands for a row's value."""
    parts = [F.coalesce(F.col(p[1:-1]).cast("string"), F.lit("")) if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
    return rows.withColumn(out, ask(F.concat(*parts) if parts else F.lit("")))


@_tool("ai.extract_json")
def extract_json(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Add the JSON value (VARIANT) that a model's answer holds: in a fenced block, alone, or from its first bracket to its last; null if there is none."""
    c = F.coalesce(F.col(text), F.lit(""))
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    inner = F.regexp_extract(c, r"(?s)(\{.*\}|\[.*\])", 1)
    whole = lambda x: F.try_parse_json(F.when(F.trim(x) != "", x))
    return rows.withColumn(out, F.coalesce(whole(fenced), whole(c), whole(inner)))


@_tool("templates.list")
def list_templates(nodes: DataFrame, edges: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """(name, kind, uses) of the templates of nodes and, if given, edges, most used first."""
    found = nodes.groupBy(F.col("template_id").alias("name")).agg(F.count("*").alias("uses")).withColumn("kind", F.lit("node"))
    if edges is not None:
        found = found.unionByName(edges.groupBy(F.col("template_id").alias("name")).agg(F.count("*").alias("uses")).withColumn("kind", F.lit("edge")))
    found = found.where("name is not null").select("name", "kind", "uses")
    return (found if kind is None else found.where(F.col("kind") == kind)).orderBy(F.desc("uses"), "name", "kind")


def tool_schema(name: str) -> dict:
    """A tool's inputs as JSON schema, from its signature: names, types, defaults, which are required, and what it says of itself."""
    kinds = {"str": "string", "int": "integer", "float": "number", "bool": "boolean", "list": "array", "dict": "object", "DataFrame": "table", "Callable": "function"}
    tool, properties, required = TOOLS[name], {}, []
    for n, p in inspect.signature(tool).parameters.items():
        said = str(p.annotation)
        properties[n] = {"type": kinds.get(re.match(r"\w*", said)[0], "string")}
        if "| None" in said:
            properties[n]["nullable"] = True
        if p.default is inspect.Parameter.empty:
            required.append(n)
        else:
            properties[n]["default"] = p.default
    return {"name": name, "description": inspect.getdoc(tool), "input": {"type": "object", "properties": properties, "required": required}, "output": {"type": "table"}}


#: What makes a user's pattern unsafe: a repeated group that repeats inside or chooses between alternatives, and references back.
_UNSAFE = (re.compile(r"\((?:[^()\\]|\\.)*(?:[+*]|\{\d+,\d*\})(?:[^()\\]|\\.)*\)(?:[+*]|\{\d+,\d*\})"), re.compile(r"\((?:[^()\\]|\\.)*\|(?:[^()\\]|\\.)*\)(?:[+*]|\{\d+,\d*\})"), re.compile(r"\\[1-9]|\(\?P=|\(\?\(|\(\?[<!=]|\\k<"))
LONGEST_PATTERN = 500


class UnsafePattern(ValueError):
    """A pattern whose cost could explode."""


def safe_pattern(pattern: str) -> str:
    """The pattern itself; too long ones, nested repeats, references and look-around are refused, as is what doesn't compile."""
    if len(pattern) > LONGEST_PATTERN:
        raise UnsafePattern(f"longer than {LONGEST_PATTERN} characters")
    if any(p.search(pattern) for p in _UNSAFE):
        raise UnsafePattern("repeats inside repeats, references and look-around aren't allowed")
    try:
        re.compile(pattern)
    except re.error as e:
        raise UnsafePattern(str(e)) from e
    return pattern


class TimedPatterns:
    """Users' patterns with a limit of time that stops a match: one that reaches it for some texts ``most`` times is switched off."""

    def __init__(self, patterns: dict[str, str], seconds: float = 0.1, most: int = 3):
        self.patterns = {n: UserPattern(p, seconds) for n, p in patterns.items()}
        self.most = most

    @property
    def timeouts(self) -> dict[str, int]:
        return {n: p.timeouts for n, p in self.patterns.items()}

    def search(self, text: str) -> list[str]:
        """Names of the patterns found in a text."""
        return [n for n, p in self.patterns.items() if p.timeouts < self.most and p.search(text)]


def clean(docs: DataFrame, text: str = "text", out: str = "text") -> DataFrame:
    """Run all cleaners in order; each step is a column of its own, so none is evaluated twice."""
    value = F.col(text)
    for applies, change in CLEANERS:
        value = F.when(applies(value), change(value)).otherwise(value)
        docs = docs.withColumn(out, value)
        value = F.col(out)
    return docs
