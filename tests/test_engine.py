import json

import pytest

from tessera import cli
from tessera.operators import claims as C
from tessera.operators import merge as G
from tessera.operators import resolve as R
from tessera.operators.components import connected_components
from tessera.pipeline import run
from tessera.plans.config import ConfigError, from_dict
from tessera.plans.paths import PathError, parse
from tessera.plans.project import OutputValidationError, ProjectionError, project, to_dicts
from tessera.schema import PROFILE_FIELDS, claim_schema

EVERY = {"fields": [{"path": f, "type": t, "required": f in ("candidate_id", "overall_confidence")} for f, t in zip(PROFILE_FIELDS, ["string", "string", "string[]", "string[]", "object", "object", "string", "number", "object[]", "object[]", "object[]", "object[]", "object[]", "number"], strict=True)]}
SHORT = {
    "fields": [
        {"path": "full_name", "type": "string", "required": True},
        {"path": "primary_email", "from": "emails[0]", "type": "string", "required": True},
        {"path": "phone", "from": "phones[0]", "type": "string", "normalize": "E164"},
        {"path": "skills", "from": "skills[].name", "type": "string[]", "normalize": "canonical"},
    ],
    "include_confidence": True,
}
#: Identity, name and confidence of the seven people.
GOLD = [
    ("2d3059187ba10e82", "Dana Lee", 0.2913),
    ("3c3ece3602adb745", "Michael Smith", 0.2913),
    ("8e5dfabced190ccd", "Priya Nair", 0.7863),
    ("93ef343ca38bde67", "Michael Smith", 0.7863),
    ("d4f8261d14faeded", "Sofia Alvarez", 0.8853),
    ("e612c343e2cc2956", "Robert Chen", 0.7505),
    ("f87f630956006036", "Jonathan Park", 0.8702),
]


@pytest.fixture(scope="module")
def result(spark, data):
    return run(spark, [data / "inputs"], from_dict(EVERY), data / "recorded")


@pytest.fixture(scope="module")
def people(result):
    return list(to_dicts(result.output))


def test_gold_profiles(people):
    assert [(p["candidate_id"], p["full_name"], p["overall_confidence"]) for p in people] == GOLD


def test_merged_profile(people):
    park = people[6]
    assert {s["name"]: (s["confidence"], s["sources"]) for s in park["skills"]} == {
        "Django": (0.4125, ["notes"]), "Go": (0.76, ["github"]), "PostgreSQL": (0.4125, ["notes"]), "Python": (0.859, ["github", "notes"]), "TypeScript": (0.76, ["github"]),
    }
    assert park["links"]["github"] == "jonpark" and park["phones"] == ["+14155550101"]
    assert [e["title"] for e in park["experience"]] == ["Senior Backend Engineer", "Staff Backend Engineer"]
    chen = people[5]
    assert chen["emails"] == ["r.chen@globex.com", "robert.chen@globex.com"] and chen["location"] == {"city": "Boston", "region": None, "country": "US"}
    assert people[2]["abstentions"] == [{"field": "phones", "source": "csv", "reason": "e164_no_region"}] and people[2]["phones"] == []


def test_diagnostics(result):
    assert sum(n.startswith("possible_duplicate: csv:2 (michael smith) ~ notes:1") for n in result.diagnostics) == 1
    assert any("about.md" in n for n in result.diagnostics)


def test_short_config(spark, result):
    rows = list(to_dicts(project(result.profiles, from_dict(SHORT))))
    assert rows[6] == {
        "full_name": "Jonathan Park", "primary_email": "jon.park@example.com", "phone": "+14155550101", "skills": ["Django", "Go", "PostgreSQL", "Python", "TypeScript"],
        "confidence": {"full_name": 0.7054, "primary_email": 0.9983, "phone": 0.9882, "skills": 0.859},
    }
    assert rows[2]["phone"] is None and rows[2]["confidence"]["phone"] == 0.0 and rows[2]["skills"] == []


def test_policies(result):
    def one(**field):
        return list(to_dicts(project(result.profiles, from_dict({"fields": [{"path": "x", "from": "headline", "type": "string", **field}]}))))[0]

    assert one() == {"x": None}
    assert one(on_missing="omit") == {}
    with pytest.raises(ProjectionError, match="on_missing=error"):
        one(on_missing="error")
    with pytest.raises(ProjectionError, match="required but missing$"):
        one(required=True)
    with pytest.raises(ProjectionError, match="contradiction"):
        one(required=True, on_missing="omit")


def test_types(result):
    with pytest.raises(OutputValidationError):
        project(result.profiles, from_dict({"fields": [{"path": "emails", "type": "string"}]}))
    with pytest.raises(OutputValidationError):
        project(result.profiles, from_dict({"fields": [{"path": "s", "from": "experience[].start", "type": "string[]"}]}))
    out = project(result.profiles, from_dict({"fields": [{"path": "s", "from": "skills[].nothing", "type": "string[]"}, {"path": "last", "from": "emails[-1]", "type": "string"}, {"path": "far", "from": "emails[9]", "type": "string"}]}))
    assert list(to_dicts(out))[5] == {"s": [], "last": "robert.chen@globex.com", "far": None}


@pytest.mark.parametrize(
    "config",
    [[], {}, {"fields": []}, {"fields": [1]}, {"fields": [{"path": "emials"}]}, {"fields": [{"path": "emails"}, {"path": "emails"}]}, {"fields": [{"path": "a", "from": "skills[].x[]"}]}, {"fields": [{"path": "emails", "normalize": "x"}]}, {"fields": [{"path": "emails", "type": "x"}]}, {"fields": [{"path": "emails", "on_missing": "x"}]}, {"fields": [{"path": "emails"}], "on_missing": "x"}],
)
def test_bad_configs(config):
    with pytest.raises(ConfigError):
        from_dict(config)


def test_paths():
    assert [(s.name, s.kind, s.index) for s in parse("a.b[-1].c[]")] == [("a", "plain", None), ("b", "index", -1), ("c", "each", None)]
    for bad in ("", "a.", "a[x]", "a[].b[0]", "1a"):
        with pytest.raises(PathError):
            parse(bad)


def test_a_bad_source_does_not_stop_the_others(spark, data, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xff\xfe\x00\x01\x02")
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.csv").write_text("name,email\nAnn Lee,ann@x.org\n")
    got = run(spark, [tmp_path, tmp_path / "none.csv"], from_dict({"fields": [{"path": "full_name", "type": "string"}]}), tmp_path)
    assert list(to_dicts(got.output)) == [{"full_name": "Ann Lee"}]
    assert len([n for n in got.diagnostics if "skipped" in n]) == 3


def claim(key, field, value, source="csv", method="direct_field", seq=0):
    return (key, seq, field, value, "object" if value.startswith("{") else "scalar", value, source, method, 1.0, False, None)


def test_cascade(spark):
    job = '{"company":"Globex","end":null,"start":null,"summary":null,"title":null}'
    rows = [
        claim("a", "full_name", "Robert Chen"), claim("a", "experience", job), claim("a", "emails", "hr@globex.com"),
        claim("b", "full_name", "Robert Chen"), claim("b", "experience", job),
        claim("c", "full_name", "Robert Chen"), claim("c", "emails", "rc@gmail.com"),
        claim("d", "emails", "rc@gmail.com"), claim("d", "emails", "hr@globex.com"),
        claim("e", "full_name", "Zed Quill"),
    ]
    claims = spark.createDataFrame(rows, claim_schema())
    views = R.records(claims)
    tiers = R.classify(R.candidate_pairs(views), views)
    got = {(r["left"], r["right"]): r["tier"] for r in tiers.collect()}
    assert got == {("a", "b"): "tier2", ("a", "c"): "tier3", ("b", "c"): "tier3", ("c", "d"): "tier1"}
    clusters = R.components(views, tiers)
    assert {r["entity_key"]: r["cluster_id"] for r in clusters.collect()} == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e"}
    assert {r["cluster_id"]: r["tier"] for r in R.weakest_tiers(clusters, tiers).collect()} == {"a": "tier2", "c": "tier1", "e": "singleton"}


def test_rivals_and_repeats(spark):
    from pyspark.sql import functions as F

    rows = [claim("a", "full_name", "Jon"), claim("b", "full_name", "Jonathan", "notes", "regex_extract"), claim("a", "emails", "x@y.de"), claim("b", "emails", "x@y.de")]
    claims = spark.createDataFrame(rows, claim_schema()).withColumn("cluster_id", F.lit("a"))
    got = {r["field_path"]: r["confidence"] for r in G.winners(G.supports(claims)).collect()}
    assert got["full_name"] == pytest.approx(0.5723, abs=0.0005)
    assert G.unions(G.supports(claims)).first()["confidence"] == 0.9775
    unknown = spark.createDataFrame([claim("a", "full_name", "Jon", "elsewhere")], claim_schema()).withColumn("cluster_id", F.lit("a"))
    with pytest.raises(Exception, match="no score"):
        G.supports(unknown).collect()


def test_region_of_a_record_reads_its_numbers(spark):
    place = '{"city":"London","country":"United Kingdom","region":null}'
    rows = [claim("a", "location", place), claim("a", "phones", "(20) 7946 0958"), claim("b", "phones", "(20) 7946 0958"), claim("a", "emails", "bad@@x")]
    got = {(r["entity_key"], r["field_path"]): (r["value"], r["failed_method"]) for r in C.normalize(spark.createDataFrame(rows, claim_schema())).collect()}
    assert got[("a", "phones")] == ("+442079460958", None) and got[("b", "phones")] == (None, "e164_no_region") and ("a", "emails") not in got


def test_components(spark):
    import random

    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 60) if i % 13] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(1, 1), (None, 3)] + [(300, x) for x in range(301, 340)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for e in edges for n in e if None not in e and e[0] != e[1]}
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_cli(spark, data, tmp_path, capsys):
    (tmp_path / "c.json").write_text(json.dumps(SHORT))
    (tmp_path / "bad.json").write_text("{}")
    (tmp_path / "strict.json").write_text(json.dumps({"fields": [{"path": "headline", "type": "string", "required": True}]}))
    base = ["-i", str(data / "inputs"), "--recorded", str(data / "recorded"), "-c"]
    assert cli.main([*base, str(tmp_path / "bad.json")]) == 2
    assert cli.main([*base, str(tmp_path / "strict.json")]) == 1
    assert cli.main([*base, str(tmp_path / "c.json"), "-o", str(tmp_path / "out.json")]) == 0
    assert len(json.loads((tmp_path / "out.json").read_text())) == 7


def test_a_field_needs_a_type():
    with pytest.raises(ConfigError):
        from_dict({"fields": [{"path": "full_name"}]})


def test_json_lines_leave_out_what_is_omitted(spark, tmp_path):
    from tessera.plans.project import write_json_lines

    rows = spark.createDataFrame([("a", None, ["x"], []), (None, 'q"u', None, ["a b"]), (None, None, [], ["a b", "d"])], "`a b` string, c string, d array<string>, _omitted array<string>")
    write_json_lines(rows.coalesce(1), str(tmp_path / "lines"))
    got = [json.loads(line) for f in sorted((tmp_path / "lines").glob("part-*")) for line in f.read_text(encoding="utf-8").splitlines()]
    assert got == [{"a b": "a", "c": None, "d": ["x"]}, {"c": 'q"u', "d": None}, {"c": None}]


def test_record_numbers_of_many_files_stay_apart(spark):
    from tessera.sources.readers import csv_claims

    rows = spark.createDataFrame([(f, i, {"name": f"n{f}.{i}"}, None, None) for f in (0, 512, 60_000) for i in (0, 5_000_000)], "file int, idx long, fields map<string,string>, items array<string>, error string")
    got = [r["value"] for r in csv_claims(rows, True).orderBy("claim_seq").collect()]
    assert got == [f"n{f}.{i}" for f in (0, 512, 60_000) for i in (0, 5_000_000)]


def test_a_number_that_very_many_records_have(spark):
    """Links grow with the records, not with their pairs; a number that only ends alike is compared."""
    n = 10_000
    rows = spark.range(n).selectExpr("concat('csv:', id) AS entity_key", "id AS record_seq", "'+14155550101' AS phone", "concat('name ', id) AS name")
    rows = rows.unionByName(spark.createDataFrame([("csv:x", n + 1, "+4414155550101", "name 7"), ("csv:y", n + 2, "+4414155550101", "other")], rows.schema))
    claims = C.emit(rows, "csv", "direct_field", [C.scalar("phones", rows["phone"]), C.scalar("full_name", rows["name"])])
    clusters, tiers, duplicates = R.resolve(claims)
    sizes = sorted(r["count"] for r in clusters.groupBy("cluster_id").count().collect())
    assert sizes == [2, n] and {r["tier"] for r in tiers.collect()} == {"tier1"}
    assert [(r["left"], r["right"]) for r in duplicates.where("right = 'csv:x' and left_name = right_name").collect()] == [("csv:7", "csv:x")]
