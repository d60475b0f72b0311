"""The toxicity classifier against plain versions of its steps."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, toxicity
from tests.llm.conftest import prose


def grams_of(text):
    """Slots of the distinct character n-grams of a text, in plain Python."""
    out, low = set(), text.lower()
    for i, order in enumerate(toxicity.ORDERS):
        for at in range(len(low) - order + 1):
            h = 0
            for ch in low[at : at + order]:
                h = (h * 0x01000193) & 0xFFFFFFFF
                h ^= ord(ch)
                h = (h * 0x9E3779B1) & 0xFFFFFFFF
            out.add(h >> (32 - toxicity.BITS) | i << toxicity.BITS)
    return out


@pytest.fixture(scope="module")
def labelled():
    rng, rows = random.Random(4), []
    for i in range(120):
        words = prose(rng, rng.randint(3, 40)).split()
        if i % 3 == 0:
            words.insert(rng.randrange(len(words)), "Blockhead")
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


def test_present_is_the_plain_set():
    texts = ["Abc é中 abc abc", "", "ab", "abcdef"]
    doc, feature = toxicity.present(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        assert set(feature[doc == i]) == grams_of(t) and (doc == i).sum() == len(grams_of(t))


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(2)
    text, code = prose(rng, 400), np.full(len(toxicity.ORDERS) << toxicity.BITS, -1, np.int32)
    some = sorted(grams_of(text))[::7]
    code[some] = np.arange(len(some))
    model = toxicity.Model(code, np.linspace(-1, 1, len(some)), 0.3)
    one = pa.array([text], pa.large_string())
    want, whole, score = [toxicity.present(one, c) for c in (None, code)], grams_of(text), model.scores(one)
    monkeypatch.setattr(toxicity, "PIECE", 100)
    for c, w in zip((None, code), want, strict=True):
        got = toxicity.present(one, c)
        assert (got[0] == w[0]).all() and (got[1] == w[1]).all()
    assert set(toxicity.present(one)[1]) == whole and model.scores(one) == pytest.approx(score)


def test_model_is_that_of_plain_ratios_and_its_scores_are_plain_sums(spark, labelled):
    frame = spark.createDataFrame(labelled, "doc_id long, text string, toxic int")
    model = toxicity.train(frame.drop("toxic"), frame.select("doc_id", "toxic"))
    sets = {i: grams_of(t) for i, t, _ in labelled}
    toxic, other = [i for i, _, y in labelled if y], [i for i, _, y in labelled if not y]
    want = {}
    for slot in set().union(*sets.values()):
        p, q = sum(slot in sets[i] for i in toxic), sum(slot in sets[i] for i in other)
        r = math.log((p + 1) / (len(toxic) + 2)) - math.log((q + 1) / (len(other) + 2))
        z = r / math.sqrt(1 / (p + 1) - 1 / (len(toxic) + 2) + 1 / (q + 1) - 1 / (len(other) + 2))
        if p + q >= 4 and abs(z) >= 3:
            want[slot] = r
    assert set(np.flatnonzero(model.code >= 0)) == set(want)
    slots = np.array(sorted(want))
    features = model.code[slots]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect()}
    for i, _, _ in labelled:
        total = model.intercept + sum(model.weight[f] for s, f in zip(slots, features, strict=True) if s in sets[i])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9)
    # the weights are near the least of the loss of the scaled features
    ratio = np.zeros(len(slots))
    ratio[features] = [want[s] for s in slots]
    x = np.array([[s in sets[i] for s in slots[np.argsort(features)]] for i, _, _ in labelled]) * ratio
    y = np.array([t for *_, t in labelled])
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    def loss(w, b):
        z = x @ w + b
        return (weight * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z)).sum() + 0.01 * (w**2).sum() / len(y)

    w, b = np.zeros(len(ratio)), 0.0
    for _ in range(4000):
        e = (1 / (1 + np.exp(-(x @ w + b))) - y) * weight
        w, b = w - 0.5 * (x.T @ e + 0.02 * w / len(y)), b - 0.5 * e.sum()
    assert loss(model.weight / ratio, model.intercept) <= loss(w, b) + 0.02


def test_repeated_ids_teach_alike_in_any_order(spark, labelled):
    rows = [*labelled, *((i, f"another text of {i} " * 3, 1 - y) for i, _, y in labelled[:30])]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    models = [toxicity.train(spark.createDataFrame([(i, t) for i, t, _ in x], "doc_id long, text string").repartition(n), labels.repartition(n)) for x, n in ((rows, 2), (rows[::-1], 5))]
    assert (models[0].code == models[1].code).all() and models[0].weight == pytest.approx(models[1].weight)


def test_query_on_null_ids(spark, labelled, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled] + [(None, "no id"), (None, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in labelled], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op9_toxicity(spark, str(tmp_path))
    assert got.count() == 122 and got.where(F.col("held_out").isNull() | F.col("score").isNull()).count() == 0
    assert [r["held_out"] for r in got.where("doc_id is null").collect()] == [False, False]
