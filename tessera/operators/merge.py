"""One profile for each cluster: what its claims say, and how sure that is.

A claim's belief is trust of its source * reliability of its method * quality of its normal form. Beliefs in one value combine by noisy-or;
a rival value discounts the winner by its share. Everything is keyed by cluster, so that one shuffle and one aggregate serve all fields.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.claims import live
from tessera.operators.storage import materialize
from tessera.resources import load
from tessera.schema import EXPERIENCE, LOCATION, profile_schema

SINGLE = ("full_name", "location", "headline", "years_experience")
LISTS = ("emails", "phones")
LINKS = ("linkedin", "github", "portfolio")
PLACES = 4


def _table(name: str) -> Column:
    values = load("scoring")[name]
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])


def believed(claims: DataFrame) -> DataFrame:
    """Live claims with ``belief`` and ``trust``; a source or method without a score is an error."""
    trust, rel = F.try_element_at(_table("trust"), F.col("source")), F.try_element_at(_table("rel"), F.col("method"))
    checked = F.when(trust.isNull() | rel.isNull(), F.raise_error(F.concat(F.lit("no score for source or method: "), F.col("source"), F.lit("/"), F.col("method")))).otherwise(trust)
    return live(claims).withColumn("trust", checked.cast("double")).withColumn("belief", F.col("trust") * rel * F.col("norm_quality"))


def noisy_or(counted: Column) -> Column:
    """1 - product of (1 - belief) ** n over structs (belief, n), in the order of beliefs."""
    return 1 - F.aggregate(F.sort_array(counted), F.lit(1.0), lambda a, x: a * F.pow(1 - x["belief"], x["n"]))


def doubt(counted: Column) -> Column:
    """The logarithm of what ``noisy_or`` takes from 1: it still tells values apart whose supports have all become 1.0."""
    return F.aggregate(F.sort_array(counted), F.lit(0.0), lambda a, x: a + x["n"] * F.coalesce(F.log1p(-x["belief"]), F.lit(float("-inf"))))


def supports(claims: DataFrame) -> DataFrame:
    """For each cluster, field and distinct value: combined support, its doubt, best trust, sources.

    Claims are counted by belief and source before they are gathered, so that a value which very many claims repeat
    is gathered as a few counts. The result is laid out by cluster for the reducers.
    """
    key = ["cluster_id", "field_path", "value"]
    counted = believed(claims).groupBy(*key, "source", "trust", "belief").agg(F.count(F.lit(1)).alias("n"))
    beliefs = F.collect_list(F.struct("belief", "n"))
    found = counted.groupBy(*key).agg(noisy_or(beliefs).alias("support"), doubt(beliefs).alias("doubt"), F.max("trust").alias("trust"), F.array_sort(F.collect_set("source")).alias("sources"))
    return found.repartition("cluster_id")


def ranked(supported: DataFrame, exact: bool = False) -> DataFrame:
    """``supported`` with the ``rank`` of each value in its field and the ``confidence`` it has as the winner.

    Supports that are equal as doubles are ties, unless ``exact``: then the lesser doubt comes first.
    """
    most = F.asc("doubt") if exact else F.desc("support")
    order = Window.partitionBy("cluster_id", "field_path").orderBy(most, F.desc("trust"), "value")
    rival = F.coalesce(F.lead("support").over(order), F.lit(0.0))
    share = F.col("support") * F.col("support") / (F.col("support") + rival)
    return supported.withColumn("confidence", F.round(share, PLACES)).withColumn("rank", F.row_number().over(order))


def winners(supported: DataFrame, exact: bool = False) -> DataFrame:
    """(cluster_id, field_path, value, confidence): the value with the most support; ties go to trust, then to the lesser value.

    The confidence is the winner's support times its share against the second value. ``exact``: see ``ranked``.
    """
    return ranked(supported, exact).where("rank = 1").select("cluster_id", "field_path", "value", "confidence")


def unions(supported: DataFrame, fields: tuple[str, ...] = LISTS) -> DataFrame:
    """(cluster_id, field_path, values, confidence): all values, sorted; as sure as the best."""
    kept = supported.where(F.col("field_path").isin(*fields))
    return kept.groupBy("cluster_id", "field_path").agg(F.array_sort(F.collect_list("value")).alias("values"), F.round(F.max("support"), PLACES).alias("confidence"))


def skills(supported: DataFrame) -> DataFrame:
    """(cluster_id, skills, confidence), by name."""
    each = F.struct(F.col("value").alias("name"), F.round("support", PLACES).alias("confidence"), "sources")
    return supported.where("field_path = 'skills'").groupBy("cluster_id").agg(F.sort_array(F.collect_list(each)).alias("skills"), F.round(F.max("support"), PLACES).alias("confidence"))


def canonical_text(value: Column) -> Column:
    """The JSON text that orders objects: sorted keys, a space after separators, ASCII only."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(json.loads(t), sort_keys=True), na_action="ignore")

    return run(value)


def objects(supported: DataFrame, field: str, ddl: str) -> DataFrame:
    """(cluster_id, objects, confidence): distinct objects in the order of their canonical JSON text."""
    kept = supported.where(F.col("field_path") == field)
    listed = F.sort_array(F.collect_list(F.struct(canonical_text(F.col("value")).alias("k"), F.from_json("value", ddl).alias("o"))))
    return kept.groupBy("cluster_id").agg(F.transform(listed, lambda x: x["o"]).alias("objects"), F.round(F.max("support"), PLACES).alias("confidence"))


def links(won: DataFrame) -> DataFrame:
    """(cluster_id, links, confidence) from the winners of links.*."""
    kept = won.where(F.col("field_path").startswith("links."))
    of = [F.max(F.when(F.col("field_path") == f"links.{k}", F.col("value"))).alias(k) for k in LINKS]
    pivot = kept.groupBy("cluster_id").agg(*of, F.max("confidence").alias("confidence"))
    return pivot.select("cluster_id", F.struct(*LINKS, F.array().cast("array<string>").alias("other")).alias("links"), "confidence")


def _provenance() -> Column:
    return F.sort_array(F.collect_set(F.struct(F.col("field_path").alias("field"), "source", "method"))).alias("provenance")


def _abstentions() -> Column:
    triple = F.struct(F.col("field_path").alias("field"), "source", F.col("failed_method").alias("reason"))
    return F.sort_array(F.collect_set(F.when(F.col("abstained"), triple))).alias("abstentions")


def _identity() -> Column:
    value, field, alive = F.col("value"), F.col("field_path"), ~F.col("abstained")

    def least(name: str) -> Column:
        return F.concat(F.lit(f"{name}:"), F.min(F.when(alive & (field == name), value)))

    keys = F.concat(F.lit("entity_key:"), F.array_join(F.array_sort(F.collect_set("entity_key")), "|"))
    identity = F.coalesce(least("emails"), least("phones"), least("links.github"), least("full_name"), keys)
    return F.substring(F.sha2(identity, 256), 1, 16).alias("candidate_id")


def provenance(claims: DataFrame) -> DataFrame:
    """(cluster_id, provenance): who said anything of which field, how; losers and abstentions too."""
    return claims.groupBy("cluster_id").agg(_provenance())


def abstentions(claims: DataFrame) -> DataFrame:
    """(cluster_id, abstentions): which field of which source could not be used, and why."""
    return claims.groupBy("cluster_id").agg(_abstentions())


def profile_ids(claims: DataFrame) -> DataFrame:
    """(cluster_id, candidate_id): a digest of the least address, number, login or name, or else of the records."""
    return claims.groupBy("cluster_id").agg(_identity())


def overall(confidences: Column, cluster_confidence: Column) -> Column:
    """Weighted mean of the fields' confidences, scaled by the cluster's certainty and by the surest identity field."""
    weights = load("scoring")["importance_weights"]
    weight = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    entries = F.map_entries(confidences)
    w = F.transform(entries, lambda e: F.coalesce(F.try_element_at(weight, e["key"]), F.lit(1.0)))
    wc = F.zip_with(w, entries, lambda a, e: a * e["value"])
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    mean = F.aggregate(wc, F.lit(0.0), lambda a, x: a + x) / total
    anchor = F.greatest(F.coalesce(F.try_element_at(confidences, F.lit("full_name")), F.lit(0.0)), F.coalesce(F.try_element_at(confidences, F.lit("emails")), F.lit(0.0)))
    return F.when(total > 0, F.round(cluster_confidence * mean * (0.5 + 0.5 * anchor), PLACES)).otherwise(0.0)


def merge(claims: DataFrame, tiers: DataFrame) -> DataFrame:
    """Profiles with ``cluster_id`` and ``field_conf``; ``claims`` carry cluster_id, ``tiers`` are (cluster_id, tier)."""
    field, value, support = F.col("field_path"), F.col("value"), F.col("support")
    scored = ranked(materialize(supports(claims), "supported").repartition("cluster_id"))
    first, at = F.col("rank") == 1, {f: field == f for f in (*SINGLE, *LISTS, "skills", "experience", *[f"links.{k}" for k in LINKS])}

    def one(name: str) -> Column:
        return F.max(F.when(at[name] & first, value))

    def sure(name: str) -> Column:
        return F.max(F.when(at[name] & first, F.col("confidence")))

    def best(name: str) -> Column:
        return F.round(F.max(F.when(at[name], support)), PLACES)

    def listed(name: str, what: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(at[name], what)))

    job = F.when(at["experience"], value)
    skill = F.struct(value.alias("name"), F.round("support", PLACES).alias("confidence"), "sources")
    confidences = {f: sure(f) for f in SINGLE} | {f: best(f) for f in (*LISTS, "skills", "experience")} | {"links": F.greatest(*[sure(f"links.{k}") for k in LINKS])}
    parts = scored.withColumns({"k": canonical_text(job), "o": F.from_json(job, EXPERIENCE)}).groupBy("cluster_id")
    parts = parts.agg(
        *[one(f).alias(f) for f in SINGLE],
        *[listed(f, value).alias(f) for f in LISTS],
        listed("skills", skill).alias("skills"),
        F.transform(listed("experience", F.struct("k", "o")), lambda x: x["o"]).alias("experience"),
        F.struct(*[one(f"links.{k}").alias(k) for k in LINKS], F.array().cast("array<string>").alias("other")).alias("links"),
        F.array(*[F.struct(F.lit(f).alias("field"), c.alias("confidence")) for f, c in confidences.items()]).alias("field_conf"),
    )
    known = F.map_from_entries(F.sort_array(F.filter("field_conf", lambda x: x["confidence"].isNotNull())))
    parts = parts.withColumn("field_conf", known)
    base = claims.groupBy("cluster_id").agg(_identity(), _provenance(), _abstentions()).join(tiers, "cluster_id").join(parts, "cluster_id", "left")
    schema = profile_schema()
    base = base.withColumn("location", F.from_json("location", LOCATION)).withColumn("years_experience", F.col("years_experience").cast("double")).withColumn("education", F.array().cast(schema["education"].dataType))
    none = {"location": F.struct(*[F.lit(None).cast("string").alias(k) for k in ("city", "region", "country")]), "links": F.struct(*[F.lit(None).cast("string").alias(k) for k in LINKS], F.array().cast("array<string>").alias("other"))}
    filled = {f: F.coalesce(F.col(f), none.get(f, F.array().cast(schema[f].dataType))) for f in ("emails", "phones", "skills", "experience", "location", "links")}
    confidences = F.coalesce("field_conf", F.create_map().cast("map<string,double>"))
    base = base.withColumns(filled).withColumn("field_conf", confidences)
    certainty = F.try_element_at(_table("cluster_conf"), F.col("tier"))
    return base.withColumn("overall_confidence", overall(F.col("field_conf"), certainty)).select(*schema.fieldNames(), "cluster_id", "field_conf")
