"""Normalizers: a raw value becomes a canonical one, or the function abstains with a reason.

Each has a plain Python core that returns (value, quality, reason); those that Spark's own functions
cannot express are vectorised over the distinct values of an Arrow batch.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from dateutil import parser as dates
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.similarity import token_set_ratio
from tessera.resources import load

FULL, LENIENT = 1.0, 0.85
RESULT = "value string, quality double, reason string"
Result = tuple[str | None, float, str | None]


def strip_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def name(raw: str | None) -> Result:
    """Title case without accents; lenient where other characters than those of Latin names remain."""
    text = " ".join(strip_accents(raw or "").split()).title()
    if not text:
        return None, 0.0, "name_empty"
    return text, FULL if re.fullmatch(r"[A-Za-z][A-Za-z'\-. ]*", text) else LENIENT, None


@cache
def _plans() -> tuple[dict, dict]:
    plans = {code: (regions, trunk, re.compile(pattern)) for code, (regions, trunk, pattern) in load("phones")["plans"].items()}
    return plans, {region: code for code, (regions, _, _) in plans.items() for region in regions}


#: What follows a number to name a line behind it; no part of E.164.
EXTENSION = re.compile(r"(?i)[\s,;]*(?:extension|ext\.?|x|#)[\s.:=]*\d{1,7}$")


def phone(raw: str | None, region: str | None = None) -> Result:
    """E.164 of a number that is valid in its plan; without a leading + the region's plan is used."""
    reason = "e164_invalid" if region else "e164_no_region"
    text = EXTENSION.sub("", (raw or "").strip())
    digits = re.sub(r"\D", "", text)
    if not digits or re.search("[A-Za-z]", text):
        return None, 0.0, reason
    plans, codes = _plans()
    if text.startswith("+"):
        code = next((digits[:n] for n in (1, 2, 3) if digits[:n] in plans), None)
        national = digits[len(code) :] if code else ""
    else:
        code = codes.get(region or "")
        national = digits
        if code:
            trunk = plans[code][1]
            if trunk and national.startswith(trunk) and plans[code][2].fullmatch(national[len(trunk) :]):
                national = national[len(trunk) :]
    if code and plans[code][2].fullmatch(national):
        return f"+{code}{national}", FULL, None
    return None, 0.0, reason


def year_month(raw: str | None) -> Result:
    """YYYY-MM; a bare year stays a year, leniently."""
    from datetime import datetime

    text = (raw or "").strip()
    if re.fullmatch(r"\d{4}", text):
        return text, LENIENT, "year_only"
    try:
        return dates.parse(text, default=datetime(2000, 1, 1)).strftime("%Y-%m"), FULL, None
    except (ValueError, OverflowError):
        return None, 0.0, "yyyymm"


def skill(raw: str | None) -> Result:
    """Alias, then canonical name, then the first best fuzzy match, else the words as they are, leniently."""
    text = (raw or "").strip()
    if not text:
        return "", LENIENT, None
    table = load("skills")
    exact = {c.lower(): c for c in table["canonical"]}
    if found := table["aliases"].get(text.lower()) or exact.get(text.lower()):
        return found, FULL, None
    best = max(table["canonical"], key=lambda c: token_set_ratio(text, c))
    return (best, FULL, None) if token_set_ratio(text, best) >= table["threshold"] else (text, LENIENT, None)


def vectorised(core: Callable[..., Result], columns: int = 1) -> Callable[..., Column]:
    """A Column function of ``core`` that runs once for each distinct input of a batch."""

    def over(*series: pd.Series) -> pd.DataFrame:
        keys = list(zip(*(s.where(s.notna(), None) for s in series), strict=True))
        known = {k: core(*k) for k in dict.fromkeys(keys)}
        return pd.DataFrame([known[k] for k in keys], columns=["value", "quality", "reason"])

    if columns == 1:

        @F.pandas_udf(RESULT)
        def one(a: pd.Series) -> pd.DataFrame:
            return over(a)

        return one

    @F.pandas_udf(RESULT)
    def two(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return over(a, b)

    return two


def name_column(raw: Column) -> Column:
    return vectorised(name)(raw)


def phone_column(raw: Column, region: Column) -> Column:
    return vectorised(phone, 2)(raw, region)


def date_column(raw: Column) -> Column:
    return vectorised(year_month)(raw)


def skill_column(raw: Column) -> Column:
    return vectorised(skill)(raw)


#: Field -> its normalizer of (raw value, region), for those that Spark's functions cannot express.
CORES: dict[str, Callable[[str | None, str | None], Result]] = {"phones": phone, "full_name": lambda raw, region: name(raw), "skills": lambda raw, region: skill(raw)}


def field_column(field: Column, raw: Column, region: Column) -> Column:
    """The result of each row's own normalizer, null where its field has none; once for each distinct input of a batch."""

    @F.pandas_udf(RESULT)
    def run(fields: pd.Series, values: pd.Series, regions: pd.Series) -> pd.DataFrame:
        keys = list(zip(fields, values.where(values.notna(), None), regions.where(regions.notna(), None), strict=True))
        known = {k: CORES[k[0]](*k[1:]) if k[0] in CORES else (None, None, None) for k in dict.fromkeys(keys)}
        return pd.DataFrame([known[k] for k in keys], columns=["value", "quality", "reason"])

    mine = field.isin(*CORES)
    return F.when(mine, run(F.when(mine, field), F.when(mine, raw), F.when(field == "phones", region)))


#: A dot-atom, an at sign, and a domain of labels that ends in letters; other characters than ASCII may stand where letters may.
_ATOM, _ALNUM = r"[a-z0-9!#$%&'*+/=?^_`{|}~\x{80}-\x{10FFFF}-]+", r"[a-z0-9\x{80}-\x{10FFFF}]"
EMAIL = rf"^{_ATOM}(\.{_ATOM})*@({_ALNUM}(({_ALNUM}|-){{0,61}}{_ALNUM})?\.)+([a-z\x{{80}}-\x{{10FFFF}}]{{2,63}}|xn--[a-z0-9-]+)$"
#: Top-level domains that no address on the Internet has (RFC 6761 and RFC 7686).
SPECIAL_USE = ("arpa", "invalid", "local", "localhost", "onion", "test")


def email_column(raw: Column) -> Column:
    """Lower case; abstains where the syntax is wrong. Spark functions only."""
    text = F.lower(F.trim(raw))
    good = text.rlike(EMAIL) & (F.length(text) <= 254) & (F.length(F.substring_index(text, "@", 1)) <= 64) & ~F.substring_index(text, ".", -1).isin(*SPECIAL_USE)
    return F.struct(F.when(good, text).alias("value"), F.when(good, FULL).otherwise(0.0).alias("quality"), F.when(~F.coalesce(good, F.lit(False)), "email_syntax").alias("reason"))


def countries(spark: SparkSession) -> DataFrame:
    """(term, iso): lower-case codes and names of all ISO 3166 countries, as the Java platform knows them, and their official names."""
    locale = spark._jvm.java.util.Locale
    rows = {}
    for iso in locale.getISOCountries():
        here = spark._jvm.java.util.Locale.Builder().setRegion(iso).build()
        rows |= {iso.lower(): iso, here.getISO3Country().lower(): iso, here.getDisplayCountry(locale.ENGLISH).lower(): iso}
    rows |= {name.lower(): iso for iso, names in load("countries")["names"].items() for name in names}
    return spark.createDataFrame(sorted(rows.items()), "term string, iso string")
