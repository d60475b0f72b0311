"""Paths into a profile, such as ``emails[0]`` or ``skills[].name``, compiled to Columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STEP = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)(\[(-?\d+)?\])?")


class PathError(ValueError):
    """A path that is not well formed."""


@dataclass(frozen=True)
class Step:
    name: str
    kind: str  # plain, index or each
    index: int | None = None


def parse(text: str) -> tuple[Step, ...]:
    """Steps of a path: names with at most one [] in all, and no subscript after it."""
    steps: list[Step] = []
    for part in text.split("."):
        m = _STEP.fullmatch(part)
        if not m:
            raise PathError(f"bad path segment {part!r} in {text!r}")
        kind = "plain" if m[2] is None else "each" if m[3] is None else "index"
        if kind != "plain" and any(s.kind == "each" for s in steps):
            raise PathError(f"subscript after [] in {text!r}")
        steps.append(Step(m[1], kind, int(m[3]) if m[3] else None))
    return tuple(steps)


def _member(value: Column, kind: T.DataType, name: str) -> tuple[Column, T.DataType] | None:
    if isinstance(kind, T.StructType) and name in kind.fieldNames():
        return value[name], kind[name].dataType
    return None


def _getter(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


def compiled(steps: tuple[Step, ...], schema: T.StructType) -> tuple[Column, T.DataType]:
    """A Column and its type; null where the path leads nowhere. An unknown member of each element gives an empty array."""
    nothing = F.lit(None), T.NullType()
    value, kind = None, schema
    for at, step in enumerate(steps):
        found = _member(value, kind, step.name) if at else ((F.col(step.name), schema[step.name].dataType) if step.name in schema.fieldNames() else None)
        if found is None:
            return nothing
        value, kind = found
        if step.kind == "plain":
            continue
        if not isinstance(kind, T.ArrayType):
            return nothing
        if step.kind == "index":
            value, kind = F.try_element_at(value, F.lit(step.index + 1 if step.index >= 0 else step.index)), kind.elementType
            continue
        element, rest = kind.elementType, steps[at + 1 :]
        for depth, later in enumerate(rest):
            inner = _member(F.lit(None), element, later.name)
            if inner is None:
                return F.array().cast("array<string>"), T.ArrayType(T.StringType())
            if depth:
                value = F.filter(value, lambda x: x.isNotNull())
            value, element = F.transform(value, _getter(later.name)), inner[1]
        return value, T.ArrayType(element)
    return value, kind
