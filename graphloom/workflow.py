"""Workflows: steps in the order of their dependencies, values filled into their inputs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame

_MARK = re.compile(r"\{\{\s*([^{}]+?)\s*\}\}")


def lookup(data: Any, path: str) -> tuple[bool, Any]:
    """(found, value) of a dotted path of keys and list places."""
    for key in path.split("."):
        if isinstance(data, dict) and key in data:
            data = data[key]
        elif isinstance(data, list) and key.lstrip("-").isdigit() and -len(data) <= int(key) < len(data):
            data = data[int(key)]
        else:
            return False, None
    return True, data


def interpolate(template: Any, data: dict) -> Any:
    """Fill {{path}} marks: one that is all of a string keeps its value's type, null inside a string is empty."""
    if isinstance(template, dict):
        return {k: interpolate(v, data) for k, v in template.items()}
    if isinstance(template, list):
        return [interpolate(v, data) for v in template]
    if not isinstance(template, str):
        return template
    whole = _MARK.fullmatch(template)
    if whole:
        return lookup(data, whole[1])[1]
    return _MARK.sub(lambda m: "" if (v := lookup(data, m[1])[1]) is None else str(v), template)


def order(steps: dict[str, Iterable[str]]) -> list[str]:
    """Names so that each follows what it depends on, by name among equals; cycles and unknown names are errors."""
    unknown = {d for ds in steps.values() for d in ds} - set(steps)
    if unknown:
        raise ValueError(f"unknown steps: {', '.join(sorted(unknown))}")
    left, out = {k: set(v) for k, v in steps.items()}, []
    while left:
        ready = sorted(k for k, v in left.items() if not v)
        if not ready:
            raise ValueError(f"steps depend on each other: {', '.join(sorted(left))}")
        out.append(ready[0])
        del left[ready[0]]
        for v in left.values():
            v.discard(ready[0])
    return out


def run(steps: dict[str, tuple[Callable[..., DataFrame], list[str]]]) -> dict[str, DataFrame]:
    """Results of steps (function, names of the results it takes)."""
    done: dict[str, DataFrame] = {}
    for name in order({k: v[1] for k, v in steps.items()}):
        f, needs = steps[name]
        done[name] = f(*[done[x] for x in needs])
    return done
