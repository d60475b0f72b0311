"""Ownership of secrets: owners and repositories both decide."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import secret_owners
from tessera.llm.joins import join_counted

VALUES = {k: f"token = {k}aB3dE6gH9kL2mN5pQ8sT1vW4" for k in ("private", "owners", "pasted", "copies")}
MIXED = {k: f"{k}ZaB3dE6gH9kL2mN5pQ8sT1vW4x" for k in ("one", "many")}


def test_owners_and_repositories_decide(spark):
    rows = [(VALUES["private"] + f" file {i}", "ann") for i in range(3)]
    rows += [(VALUES["owners"] + " x", owner) for owner in ("ann", "bob")]
    rows += [(VALUES["pasted"] + f" page {i}", "cat") for i in range(9)]
    rows += [(VALUES["copies"] + " the same text", "dan")] * 9
    rows += [(MIXED["one"], "eve"), *((MIXED["many"] + f" {i}", "eve") for i in range(9)), (None, None)]
    frame = spark.createDataFrame([(i, t, o) for i, (t, o) in enumerate(rows)], "doc_id long, text string, source string").repartition(3)
    got = {r["doc_id"]: r for r in secret_owners.scan(frame).collect()}
    live = {k: {got[i]["n_live"] for i, (t, _) in enumerate(rows) if t and v in t} for k, v in VALUES.items()}
    assert live == {"private": {1}, "owners": {0}, "pasted": {0}, "copies": {1}}
    assert all(got[i]["n_live"] + got[i]["n_copied"] == got[i]["n_assign"] == 1 for i, (t, _) in enumerate(rows) if t and "token" in t)
    assert [("owned" in got[i]["spans"]) for i, (t, _) in enumerate(rows) if t and "Z" in t and "token" not in t] == [True] + [False] * 9


def test_a_column_names_repositories(spark):
    rows = [(i, VALUES["pasted"] + f" page {i}", "cat", f"repo{i % 2}") for i in range(9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    assert {r["n_live"] for r in secret_owners.scan(frame, repo_col="repo").collect()} == {1}
    assert {r["n_live"] for r in secret_owners.scan(frame, repo_col="repo", most_repos=1).collect()} == {0}


@pytest.mark.parametrize("hot_keys", [1, 5, 10_000])
def test_common_keys_are_joined_as_others_are(spark, hot_keys):
    left = spark.createDataFrame([(i % 7 if i < 60 else i, i) for i in range(100)] + [(None, -1)], "k int, v int")
    right = left.where("k is not null and k % 5 < 3").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.col("k") * 2)
    got = sorted(tuple(r) for r in join_counted(left, right, ["k"], hot_keys).select("k", "v", "w").collect())
    assert got == sorted((i % 7 if i < 60 else i, i, 2 * (i % 7 if i < 60 else i)) for i in range(100) if (i % 7 if i < 60 else i) % 5 < 3)
