"""The class-based language model against a plain one."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import brown_lm as B
from tests.llm.test_brute import by_id, words_of


def xlogx(x):
    return x * np.log(np.maximum(x, 1))


def test_a_word_is_placed_where_the_likelihood_is_greatest():
    rng = np.random.default_rng(3)
    table = rng.integers(0, 60, (7, 7)).astype(float)
    n = rng.integers(1, 9, 200) * rng.choice([1, 40], 200)
    word = np.repeat(np.arange(200), n)
    left, right = rng.integers(0, 7, (2, len(word)))
    got = B.Placing(table).classes_of(word, left, right, 203)
    for w in range(200):
        mine, gains = word == w, []
        for k in range(6):
            t, n_w = table.copy(), mine.sum()
            np.add.at(t, (left[mine], k), 1)
            np.add.at(t, (k, right[mine]), 1)
            rows, columns = table.sum(1)[k], table.sum(0)[k]  # the word's bigrams are in them already, in the last class
            gains.append((xlogx(t) - xlogx(table)).sum() - xlogx(rows + n_w) + xlogx(rows) - xlogx(columns + n_w) + xlogx(columns))
        assert gains[got[w]] >= max(gains) - 1e-3 * max(1, abs(max(gains)))


@pytest.mark.parametrize("core", [5, 40, 5000])
def test_scores_are_those_of_the_plain_model(docs, rows, core):
    got = by_id(B.score(docs, core=core))
    tokens = {r[0]: [*words_of(r[1]), ""] for r in rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in tokens[i])
    best = sorted((w for w in c if w), key=lambda w: (-c[w], w.encode()))[:core]
    unit = {w: u for u, w in enumerate([*best, ""])}
    rest = len(unit)
    pairs = Counter((unit.get(a, rest), unit.get(b, rest)) for i in train for a, b in zip(["", *tokens[i]], tokens[i], strict=False))
    bigrams = np.zeros((rest + 1, rest + 1))
    for (a, b), n in pairs.items():
        bigrams[a, b] = n
    member = B.exchange(bigrams, B.CLASSES, apart=rest)
    assert (member[:rest] < B.CLASSES).all() and member[rest] == B.CLASSES
    onto = np.eye(B.CLASSES + 1)[member]
    placing = B.Placing(onto.T @ bigrams @ onto)
    k = {w: int(member[u]) for w, u in unit.items()}
    seen = {w: [] for w in c if w not in unit}
    for i in train:
        t = ["", *tokens[i]]
        for x, w, y in zip(t, t[1:], t[2:], strict=False):
            if w in seen:
                seen[w].append((member[unit.get(x, rest)], member[unit.get(y, rest)]))
    for w, around in seen.items():
        left, right = np.array(around).T
        k[w] = int(placing.classes_of(np.zeros(len(left), int), left, right, 1)[0])
    tokens_of, types_of, table = np.zeros(B.CLASSES), np.zeros(B.CLASSES), np.zeros((B.CLASSES, B.CLASSES))
    for w, n in c.items():
        tokens_of[k[w]] += n
        types_of[k[w]] += 1
    for i in train:
        for a, b in zip(["", *tokens[i]], tokens[i], strict=False):
            table[k[a], k[b]] += 1
    n1, n2 = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
    d = n1 / (n1 + 2 * n2)
    share = (tokens_of + 1) / (tokens_of.sum() + B.CLASSES)
    p = (table + B.PRIOR * share) / (table.sum(1, keepdims=True) + B.PRIOR)
    left_over = np.array([d * types_of[x] / tokens_of[x] if tokens_of[x] else 1.0 for x in range(B.CLASSES)])
    from_unseen = share * left_over / (share * left_over).sum()
    assert p.sum(1) == pytest.approx(np.ones(B.CLASSES))
    for x in range(B.CLASSES):  # a class's words, seen and not, sum to one
        assert sum((n - d) / tokens_of[x] for w, n in c.items() if k[w] == x) + left_over[x] == pytest.approx(1)
    for i, t in tokens.items():
        total = 0.0
        for a, b in zip(["", *t], t, strict=False):
            row = p[k[a]] if a in k else from_unseen @ p
            total += math.log10(row[k[b]] * (c[b] - d) / tokens_of[k[b]] if b in k else row @ left_over)
        assert got[i]["score"] == pytest.approx(total, rel=1e-6)
        assert got[i]["perplexity"] == pytest.approx(10 ** (-total / len(t)), rel=1e-4)


def test_every_training_word_has_a_class_of_its_own_counts(docs, rows):
    """Words that stand in like places share a class however rare they are."""
    spark = docs.sparkSession
    rng = np.random.default_rng(1)
    subjects, verbs, objects = ([f"{kind}{i}" for i in range(60)] for kind in "sob")
    texts = [" ".join(f"the {rng.choice(subjects)} does {rng.choice(verbs)} a {rng.choice(objects)} ." for _ in range(40)) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    blocks = B._blocks(frame, "doc_id", "text", B.held_out()).cache()
    best = ["the", "does", "a", "."]
    bigrams = B.core_bigrams(blocks, best)
    member = B.exchange(bigrams, B.CLASSES, apart=5)
    onto = np.eye(B.CLASSES + 1)[member]
    placed = B.placed_words(blocks, 3, dict.fromkeys(best, 1), [1, 1, 1, 1, 1], member, onto.T @ bigrams @ onto).where("block is not null").collect()
    words = {b["block"]: B.unpack_words(bytes(b["words"])).to_pylist() for b in blocks.collect()}
    k = {}
    for r in placed:
        for code, x, c in zip(B.unpack(bytes(r["codes"]), np.int32), B.unpack(bytes(r["k"]), np.uint8), B.unpack(bytes(r["c"]), np.int64), strict=True):
            if code < len(words[r["block"]]) and c:
                k[words[r["block"]][code]] = x
    for kind in (subjects, verbs, objects):
        assert len({k[w] for w in kind}) == 1


def test_packing_of_words_and_numbers():
    import pyarrow as pa

    for words in ([], ["a"], ["b", "é中", "x" * 5000]):
        assert B.unpack_words(B.pack_words(pa.array(words, pa.large_string()))).to_pylist() == words
    for x in (np.zeros(0, np.int64), np.array([1, -5, 1 << 40])):
        assert (B.unpack(B.pack(x), np.int64) == x).all()
