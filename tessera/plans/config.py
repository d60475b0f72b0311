"""Output programs: which fields of a profile to emit, under which names, types and policies."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from tessera.plans.paths import PathError, Step, parse
from tessera.schema import PROFILE_FIELDS

TYPES = ("string", "string[]", "number", "number[]", "boolean", "object", "object[]")
POLICIES = ("null", "omit", "error")
HOOKS = ("E164", "canonical")


class ConfigError(ValueError):
    """An output program that cannot be run."""


@dataclass(frozen=True)
class Field:
    path: str
    steps: tuple[Step, ...]
    type: str = "string"
    required: bool = False
    normalize: str | None = None
    on_missing: str | None = None


@dataclass(frozen=True)
class Config:
    fields: tuple[Field, ...]
    include_confidence: bool = False
    include_provenance: bool = False
    on_missing: str = "null"


def load(path: str | Path) -> Config:
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError as e:
        raise ConfigError(f"no config file {path}") from e
    except ValueError as e:
        raise ConfigError(f"config is not JSON: {e}") from e
    return from_dict(data)


def _check(good: bool, message: str) -> None:
    if not good:
        raise ConfigError(message)


def from_dict(data: object) -> Config:
    _check(isinstance(data, dict), "config must be an object")
    entries, policy = data.get("fields"), data.get("on_missing", "null")
    _check(isinstance(entries, list) and bool(entries), "config needs a list of fields")
    _check(policy in POLICIES, f"unknown on_missing {policy!r}")
    fields: list[Field] = []
    for entry in entries:
        _check(isinstance(entry, dict), "a field must be an object")
        path, own = entry.get("path"), entry.get("on_missing")
        _check(isinstance(path, str) and bool(path), "a field needs a path")
        _check(path not in [f.path for f in fields], f"path {path!r} twice")
        kind, hook, origin = entry.get("type"), entry.get("normalize"), entry.get("from", path)
        _check(kind in TYPES, f"unknown type {kind!r} of {path!r}")
        _check(isinstance(origin, str), f"from of {path!r} must be a text")
        try:
            steps = parse(origin)
        except PathError as e:
            raise ConfigError(str(e)) from e
        _check(steps[0].name in PROFILE_FIELDS, f"{path!r} starts at {steps[0].name!r}, which is no field of a profile")
        _check(hook is None or hook in HOOKS, f"unknown normalize {hook!r} of {path!r}")
        _check(own is None or own in POLICIES, f"unknown on_missing {own!r} of {path!r}")
        fields.append(Field(path, steps, kind, bool(entry.get("required", False)), hook, own))
    return Config(tuple(fields), bool(data.get("include_confidence", False)), bool(data.get("include_provenance", False)), policy)
