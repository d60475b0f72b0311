"""The engine's scalar functions under SQL names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import matching, normalize, phonetic, similarity


def _pairs(core, kind: str):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(y) else core(x, y) for x, y in zip(a, b, strict=True)])

    return run


def _singles(core):
    @F.pandas_udf("string")
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else core(x) for x in a], dtype=object)

    return run


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to ``spark.sql``; returns their names. Null in, null out."""
    known = {
        "jaro_winkler": _pairs(similarity.jaro_winkler, "double"),
        "token_set_ratio": _pairs(similarity.token_set_ratio, "double"),
        "same_name": _pairs(matching.alike, "boolean"),
        "e164": _pairs(lambda raw, region: normalize.phone(raw, region)[0], "string"),
        "sound_code": _singles(phonetic.sound_code),
        "strip_accents": _singles(normalize.strip_accents),
        "match_name": _singles(matching.match_name),
        "skill_canonical": _singles(lambda raw: normalize.skill(raw)[0]),
        "year_month": _singles(lambda raw: normalize.year_month(raw)[0]),
    }
    for name, function in known.items():
        spark.udf.register(name, function)
    return sorted(known)
