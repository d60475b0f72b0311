"""Near-duplicates of the pipeline against Jaccard similarities of all pairs."""

import random

import pytest

import corpus_pipeline as P
from tessera.llm import simhash_similar
from tests.llm.conftest import COLUMNS, prose
from tests.llm.test_brute import words_of


def shingles(text):
    w = words_of(text)
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def least_of_groups(rows):
    sets, up = {r[0]: shingles(r[1]) for r in rows}, {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.fixture(scope="module")
def edited(rows):
    """Texts with copies in which one to six words are changed, near and below the limit, and a group of such copies."""
    rng, out = random.Random(8), list(rows)
    for i in range(60):
        words = prose(rng, 150).split()
        out.append((1000 + 10 * i, " ".join(words), "en", "src1", 1))
        for j in range(1, 8 if i % 20 == 0 else 2):
            copy = list(words)
            for k in rng.sample(range(150), 1 + (i + j) % 6):
                copy[k] = f"changed{i}x{j}x{k}"
            out.append((1000 + 10 * i + j, " ".join(copy), "en", "src1", 1))
    return out


@pytest.mark.parametrize("part_rows", [2, 4096])
def test_groups_are_those_of_all_pairs(spark, edited, part_rows):
    got = simhash_similar.near_duplicates(spark.createDataFrame(edited, COLUMNS).repartition(3), part_rows=part_rows)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == least_of_groups(edited)


def test_the_stage_keeps_one_text_of_each_group(spark, edited):
    docs = spark.createDataFrame(edited, COLUMNS)
    got = [r["doc_id"] for r in P.dedup_documents(spark, docs, "").select("doc_id").collect()]
    assert sorted(got) == sorted(set(least_of_groups(edited).values()))


@pytest.mark.parametrize("n", [1, 1000, 200_000, 10**7])
def test_tables_follow_the_number_of_texts(n):
    tables = simhash_similar.tables_for(n)
    bits = tables[0][1].bit_count()
    assert all(mask.bit_count() == bits for _, mask in tables) and len(set(tables)) == len(tables)
    assert simhash_similar.expected_recall(bits, len(tables), 0.8) >= simhash_similar.RECALL
    assert simhash_similar.expected_recall(bits, len(tables), 0.85) >= 0.99


def test_recall_of_pairs_at_the_limit(spark):
    """Pairs of sets at a similarity of 0.80 to 0.83, the hardest ones, among many other texts."""
    rng, rows, pairs = random.Random(12), [], []
    for i in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(124)]
        copy = list(words)
        first = rng.randrange(30)
        for k in (first, first + 31):
            copy[k] = f"changed{i}x{k}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy[: 124 - rng.randrange(3)]))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append(2 * i)
    got = {r["doc_id"]: r["component_id"] for r in simhash_similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 300 and sum(got[i] == got[i + 1] for i in pairs) >= 0.98 * len(pairs)
