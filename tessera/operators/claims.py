"""From records to claims, and claims to normal forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.schema import CLAIM_DDL, claim_schema

#: Claims of one record are at most so many.
WIDTH = 1 << 20


def _named(field: str, kind: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(field).alias("field_path"), v.alias("value"), F.lit(kind).alias("value_kind"))


def emit(records: DataFrame, source: str, method: str, parts: list[tuple[str, Column, str]]) -> DataFrame:
    """Unpivot ``records`` (entity_key, record_seq, ...) into claims.

    ``parts``: for each claim its field, its value and whether that is a scalar or a JSON object. Null and empty values
    make no claim. A value that is an array makes one claim for each element, in order.
    """
    arrays = []
    for field, value, kind in parts:
        each = F.transform(value, _named(field, kind))
        arrays.append(F.coalesce(each, F.array().cast("array<struct<field_path:string,value:string,value_kind:string>>")))
    listed = records.select("entity_key", "record_seq", F.posexplode(F.concat(*arrays)).alias("nth", "c"))
    listed = listed.where("c.value is not null and c.value <> ''")
    return listed.select(
        "entity_key",
        (F.col("record_seq") * WIDTH + F.col("nth")).alias("claim_seq"),
        "c.field_path",
        "c.value",
        "c.value_kind",
        F.col("c.value").alias("raw_value"),
        F.lit(source).alias("source"),
        F.lit(method).alias("method"),
        F.lit(1.0).alias("norm_quality"),
        F.lit(False).alias("abstained"),
        F.lit(None).cast("string").alias("failed_method"),
    ).to(claim_schema())


def scalar(field: str, value: Column) -> tuple[str, Column, str]:
    return field, F.array(F.trim(value)), "scalar"


def several(field: str, values: Column) -> tuple[str, Column, str]:
    return field, values, "scalar"


def fields_object(field: str, **members: Column) -> tuple[str, Column, str]:
    """A JSON object, where any member is there and not empty; keys in alphabetic order, empty members null."""
    clean = {k: F.nullif(F.trim(v), F.lit("")) for k, v in sorted(members.items())}
    known = F.coalesce(*clean.values()).isNotNull()
    text = F.to_json(F.struct(*[v.alias(k) for k, v in clean.items()]), {"ignoreNullFields": "false"})
    return field, F.array(F.when(known, text)), "object"


#: Fields that name a country.
PLACES = ("location", "country")


def _place_term() -> Column:
    """The country that a claim names, as written but for case and margins."""
    country = F.when(F.col("value_kind") == "object", F.get_json_object("raw_value", "$.country")).otherwise(F.col("raw_value"))
    return F.when(F.col("field_path").isin(*PLACES), F.lower(F.trim(country)))


def region_hints(claims: DataFrame) -> DataFrame:
    """(entity_key, region): the ISO code of the first place of a record that names a country."""
    named = claims.where(F.col("field_path").isin(*PLACES)).select("entity_key", "claim_seq", _place_term().alias("term"))
    found = named.join(F.broadcast(N.countries(claims.sparkSession)), "term")
    return found.groupBy("entity_key").agg(F.min_by("iso", "claim_seq").alias("region"))


def normalize(claims: DataFrame) -> DataFrame:
    """Claims with canonical values.

    A claim that cannot be normalized keeps a null value and the reason; an e-mail address goes altogether. Fields
    without a normalizer pass unchanged. One pass over the claims: a record's place reaches its numbers by a window over the
    record, and one Python step normalizes the fields that need it.
    """
    field, raw = F.col("field_path"), F.col("raw_value")
    named = claims.withColumn("_term", _place_term()).join(F.broadcast(N.countries(claims.sparkSession).withColumnRenamed("term", "_term")), "_term", "left")
    region = F.min_by("iso", F.when(F.col("iso").isNotNull(), F.col("claim_seq"))).over(Window.partitionBy("entity_key"))
    result = F.when(field == "emails", N.email_column(raw)).otherwise(N.field_column(field, raw, F.col("_region")))
    done = named.withColumn("_region", region).withColumn("r", result)
    touched = field.isin("emails", *N.CORES)
    value = F.when(touched, F.col("r.value")).otherwise(F.col("value"))
    out = done.withColumns(
        {
            "value": value,
            "norm_quality": F.when(touched, F.col("r.quality")).otherwise(F.col("norm_quality")),
            "abstained": F.when(touched, F.col("r.value").isNull()).otherwise(F.col("abstained")),
            "failed_method": F.when(touched, F.when(F.col("r.value").isNull(), F.col("r.reason"))).otherwise(F.col("failed_method")),
        }
    )
    return out.where((field != "emails") | ~F.col("abstained")).select(*claims.columns).to(claim_schema())


def live(claims: DataFrame) -> DataFrame:
    """Claims that carry a value."""
    return claims.where(~F.col("abstained"))


__all__ = ["CLAIM_DDL", "emit", "fields_object", "live", "normalize", "region_hints", "scalar", "several"]
