"""Runs an output program over profiles.

Paths become Columns once, so Catalyst prunes what no field needs. What a record lacks is null in the frame; ``_omitted`` lists
the fields to leave out of its JSON. Policies and types are checked in one aggregate before anything is emitted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import normalize as N
from tessera.plans.config import Config, Field
from tessera.plans.paths import compiled
from tessera.schema import profile_schema


class ProjectionError(ValueError):
    """A value that is required, or must not be missing, is missing."""


class OutputValidationError(ValueError):
    """A value is not of the declared type."""


def _canonical_list(values: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda xs: [None if x is None else N.skill(x)[0] for x in xs], na_action="ignore")

    return run(values)


def _hooked(field: Field, value: Column, kind: T.DataType) -> Column:
    if field.normalize == "E164" and isinstance(kind, T.StringType):
        return N.phone_column(value, F.lit(None).cast("string"))["value"]
    if field.normalize == "canonical" and isinstance(kind, T.StringType):
        return F.when(value.isNotNull(), N.skill_column(value)["value"])
    if field.normalize == "canonical" and isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return _canonical_list(value)
    return value


def _fits(token: str, kind: T.DataType) -> bool:
    if token.endswith("[]"):
        return isinstance(kind, T.ArrayType) and _fits(token[:-2], kind.elementType)
    return isinstance(kind, {"string": T.StringType, "number": T.NumericType, "boolean": T.BooleanType, "object": (T.StructType, T.MapType)}[token])


def project(profiles: DataFrame, config: Config) -> DataFrame:
    """One row for each profile: the fields in order, then ``_omitted`` and, if asked for, confidence and provenance.

    Raises ProjectionError or OutputValidationError for the whole run, naming the first field at fault.
    """
    schema = profile_schema()
    names, values, kinds = [], [], []
    for i, field in enumerate(config.fields):
        value, kind = compiled(field.steps, schema)
        value = _hooked(field, value, kind)
        names.append(f"f{i}")
        values.append(value.alias(f"f{i}"))
        kinds.append(kind)
    kept = profiles.select("candidate_id", "cluster_id", "field_conf", "provenance", *values)
    faults = []
    for field, name, kind in zip(config.fields, names, kinds, strict=True):
        policy = field.on_missing or config.on_missing
        missing = F.col(name).isNull()
        if field.required:
            hint = " (config contradiction: required:true with on_missing:omit)" if policy == "omit" else ""
            faults.append((ProjectionError, f"field {field.path!r} is required but missing{hint}", missing))
        elif policy == "error":
            faults.append((ProjectionError, f"field {field.path!r} is missing and on_missing=error", missing))
        if not isinstance(kind, T.NullType) and not _fits(field.type, kind):
            faults.append((OutputValidationError, f"field {field.path!r} is not a {field.type}", ~missing))
        elif field.type.endswith("[]") and isinstance(kind, T.ArrayType):
            faults.append((OutputValidationError, f"field {field.path!r} holds an element that is not a {field.type[:-2]}", F.exists(name, lambda x: x.isNull())))
    if faults:
        counts = kept.agg(*[F.count_if(condition).alias(str(i)) for i, (_, _, condition) in enumerate(faults)]).first()
        for (error, message, _), n in zip(faults, counts, strict=True):
            if n:
                raise error(message)
    omitted = [F.when(F.col(n).isNull(), F.lit(f.path)) for f, n in zip(config.fields, names, strict=True) if (f.on_missing or config.on_missing) == "omit"]
    out = [F.col(n).alias(f.path) for f, n in zip(config.fields, names, strict=True) if not (config.include_confidence and f.path == "confidence") and not (config.include_provenance and f.path == "provenance")]
    left_out = F.array_compact(F.array(*omitted)) if omitted else F.array().cast("array<string>")
    if config.include_confidence:
        pairs = [F.struct(F.lit(f.path).alias("k"), F.coalesce(F.try_element_at("field_conf", F.lit(f.steps[0].name)), F.lit(0.0)).alias("v")) for f in config.fields]
        known = F.filter(F.array(*pairs), lambda p: ~F.array_contains(left_out, p["k"]))
        out.append(F.map_from_entries(known).alias("confidence"))
    if config.include_provenance:
        out.append(F.col("provenance"))
    return kept.orderBy("candidate_id", "cluster_id").select(*out, left_out.alias("_omitted"))


def to_dicts(rows: DataFrame) -> Iterator[dict]:
    """Output records in order, without what they omit; for results that fit the driver."""
    for row in rows.toLocalIterator():
        record = row.asDict(recursive=True)
        for name in record.pop("_omitted"):
            record.pop(name, None)
        yield record


def write_json(rows: DataFrame, path: str | None = None) -> str:
    """One pretty JSON array, to ``path`` if given."""
    text = json.dumps(list(to_dicts(rows)), indent=2, ensure_ascii=False)
    if path is not None:
        with open(path, "w", encoding="utf-8") as out:
            out.write(text + "\n")
    return text


def write_json_lines(rows: DataFrame, folder: str) -> None:
    """JSON lines in parallel, for results of any size; nulls are kept, omitted fields are left out."""
    kept = [c for c in rows.columns if c != "_omitted"]
    pieces = []
    for name in kept:
        member = F.to_json(F.struct(F.col(f"`{name}`").alias(name)), {"ignoreNullFields": "false"})
        pieces.append(F.when(~F.array_contains("_omitted", name), F.regexp_extract(member, r"(?s)^\{(.*)\}$", 1)))
    text = F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))
    rows.select(text.alias("value")).write.text(folder)
