"""The two central relations: claims and profiles."""

from __future__ import annotations

from pyspark.sql import types as T

CLAIM_DDL = (
    "entity_key string, claim_seq long, field_path string, value string, value_kind string, raw_value string, "
    "source string, method string, norm_quality double, abstained boolean, failed_method string"
)

LOCATION = "city string, region string, country string"
EXPERIENCE = "company string, title string, start string, end string, summary string"

PROFILE_DDL = (
    f"candidate_id string, full_name string, emails array<string>, phones array<string>, location struct<{LOCATION}>, "
    "links struct<linkedin string, github string, portfolio string, other array<string>>, headline string, years_experience double, "
    f"skills array<struct<name string, confidence double, sources array<string>>>, experience array<struct<{EXPERIENCE}>>, "
    "education array<struct<institution string, degree string, field string, end_year int>>, "
    "provenance array<struct<field string, source string, method string>>, abstentions array<struct<field string, source string, reason string>>, "
    "overall_confidence double"
)


def claim_schema() -> T.StructType:
    return T.StructType.fromDDL(CLAIM_DDL)


def profile_schema() -> T.StructType:
    return T.StructType.fromDDL(PROFILE_DDL)


#: Names of a profile's fields, in order; known without a session.
PROFILE_FIELDS = ("candidate_id", "full_name", "emails", "phones", "location", "links", "headline", "years_experience", "skills", "experience", "education", "provenance", "abstentions", "overall_confidence")
