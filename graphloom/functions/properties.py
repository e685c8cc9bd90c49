"""Properties of nodes and edges: typed checks, merges, literals."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL, _EMAIL = r"^https?://[^\s/$.?#].[^\s]*$", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def property_errors(properties: Column | str, template: list[dict]) -> Column:
    """Messages of what in a map<string,string> breaks a template's definitions, null if a value is fine.

    A definition has name, type (string, text, integer, float, boolean, date, datetime, url, email,
    enum) and maybe required, pattern and values.
    """
    p = F.col(properties) if isinstance(properties, str) else properties
    found = []
    for t in template:
        v, name, kind = p[t["name"]], t["name"], t.get("type", "string")
        checks = {
            "integer": v.try_cast("bigint").isNotNull(),
            "float": v.try_cast("double").isNotNull(),
            "boolean": F.lower(v).isin("true", "false"),
            "date": F.try_to_date(v).isNotNull(),
            "datetime": F.try_to_timestamp(v).isNotNull(),
            "url": v.rlike(_URL),
            "email": v.rlike(_EMAIL),
            "enum": v.isin(*t.get("values", [])),
            "string": v.rlike(t["pattern"]) if t.get("pattern") else F.lit(True),
        }
        bad = v.isNotNull() & ~checks.get(kind, F.lit(True))
        found.append(F.when(v.isNull() & F.lit(bool(t.get("required"))), f"{name}: required").when(bad, f"{name}: not {kind}"))
    return F.array_compact(F.array(*found))


def merge_maps(*maps: Column) -> Column:
    """Later maps win; unlike concatenation, a key may be in several."""
    def over(low: Column, high: Column) -> Column:
        return F.map_concat(F.map_filter(low, lambda k, v: ~F.coalesce(F.map_contains_key(high, k), F.lit(False))), high)

    return reduce(over, maps)


def _members(value: Column) -> Column:
    """An object's members by name; null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def deep_merged(a: Column, b: Column, settle: Callable[[Column, Column], Column] | None = None, depth: int = 12) -> Column:
    """Two VARIANT objects merged: members of either, and where both have one and both are objects, these merged in turn.

    ``settle`` chooses between two members that aren't both objects, the later one unless given. A member that is null is one all the same. Objects nested deeper than ``depth`` aren't
    looked into. Each row is merged where it is; nothing is shuffled.
    """
    settle = settle or (lambda x, y: y)
    x, y = _members(a), _members(b)
    if not depth:
        return settle(a, b)
    each = F.map_zip_with(x, y, lambda k, u, v: F.when(u.isNull(), v).when(v.isNull(), u).otherwise(deep_merged(u, v, settle, depth - 1)))
    return F.when(x.isNotNull() & y.isNotNull(), F.to_variant_object(each)).otherwise(settle(a, b))


def surer_value(a_sure: Column, b_sure: Column) -> Callable[[Column, Column], Column]:
    """The choice between a kept entity's value and its duplicate's: of texts the surer one's if either is shorter than 20 characters, else the longer; of lists both,
    each item once; else the kept one's."""
    items = lambda v: F.try_variant_get(v, "$", "array<variant>")
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

    def choose(a: Column, b: Column) -> Column:
        s, t, x, y = text(a), text(b), items(a), items(b)
        of_texts = F.when(F.least(F.length(s), F.length(t)) < 20, F.when(a_sure >= b_sure, a).otherwise(b)).otherwise(F.when(F.length(s) >= F.length(t), a).otherwise(b))
        both = F.transform(F.array_distinct(F.transform(F.concat(x, y), lambda v: F.to_json(v))), lambda v: F.parse_json(v))
        return F.when(x.isNotNull() & y.isNotNull(), F.to_variant_object(both)).when(s.isNotNull() & t.isNotNull(), of_texts).otherwise(a)

    return choose


def truthy(text: Column) -> Column:
    """Truth of a Python literal written as text; what isn't a literal is false."""
    t = F.trim(text)
    number = t.try_cast("double")
    return F.coalesce(
        F.when(t == "True", True)
        .when(t.isin("False", "None", "''", '""', "[]", "{}", "()"), False)
        .when(number.isNotNull(), number != 0)
        .when(t.rlike(r"""^('.*'|".*"|\[.*\]|\{.*\}|\(.*\))$"""), True),
        F.lit(False),
    )
