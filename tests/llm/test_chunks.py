"""Substring deduplication against plain passages of chunks."""

import random

import numpy as np
import pytest

from tessera.llm import chunk_dedup as C
from tessera.llm import gear
from tests.llm.conftest import prose


def plain(rows, least=C.LEAST_RUN):
    """(id, start, length, first id) of each run: passages, chunk by chunk, that any earlier place has; rows in the order of ids."""
    firsts, out = {}, set()
    for i, text in rows:
        raw = (text or "").encode()
        _, starts, ends = gear.chunks(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), C.BITS, C.MOST)
        found = []
        for k, a in enumerate(starts.tolist()):
            to = next((e for e in ends[k:].tolist() if e - a >= least), None)
            if to is None:
                break
            passage = raw[a:to]
            if passage in firsts:
                found.append((a, to, firsts[passage]))
            firsts.setdefault(passage, i)
        run = None
        for a, to, f in found:
            if run and a <= run[1]:
                run[1] = max(run[1], to)
                continue
            if run:
                out.add((i, run[0], run[1] - run[0], run[2]))
            run = [a, to, f]
        if run:
            out.add((i, run[0], run[1] - run[0], run[2]))
    return out


def runs_of(frame, **options):
    return [(r["doc_id"], r["start"], r["length"], r["first_id"]) for r in C.repeats(frame, **options).collect()]


@pytest.mark.parametrize("parts", [1, 3])
def test_repeats_are_those_of_all_passages(docs, rows, parts):
    got, want = runs_of(docs.repartition(parts)), plain([(r[0], r[1]) for r in rows])
    assert sorted(got) == sorted(want) and {r[0] for r in want} >= {19, 31, 43, 55}


def test_what_is_left_has_no_repeat_of_its_first_place(docs, rows):
    clean = {r["doc_id"]: r["text"] for r in C.without_repeats(docs, C.repeats(docs)).collect()}
    assert len(clean) == len(rows) and len(clean[5]) < 64 and clean[4] == rows[4][1]


def test_null_ids_are_documents_of_their_own(spark):
    rng = random.Random(7)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (2, b), (None, a + prose(rng, 20)), (None, prose(rng, 20) + b), (None, prose(rng, 20) + b), (None, None)]
    got = sorted(runs_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), key=lambda r: r[1])
    assert [r[0] for r in got] == [None] * 3 and sorted(r[3] for r in got) == [1, 2, 2]
    assert all(n <= len(a.encode()) + 40 for _, _, n, _ in got)


def test_rows_that_share_an_id_and_string_ids(spark):
    rng = random.Random(8)
    a = prose(rng, 80)
    other = prose(rng, 50)
    frame = spark.createDataFrame([("x", a), ("x", a), ("x", other), ("y", other + a)], "doc_id string, text string")
    got = runs_of(frame)
    assert {(i, f) for i, *_, f in got} == {("y", "x")}


def test_a_passage_of_very_many_texts(spark):
    rng = random.Random(9)
    common = prose(rng, 60)
    rows = [(i, prose(rng, 5) + (common if i % 3 == 0 else prose(rng, 60))) for i in range(600)]
    got = runs_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(got) == sorted(plain(rows)) and len({i for i, *_ in got}) == 199


def test_edges_of_isolated_passages():
    """Share of passages of 51 words that hold a whole passage of chunks, wherever they begin."""
    rng = random.Random(10)
    text = prose(rng, 12_000)
    words, hits = text.split(" "), 0
    at = np.cumsum([0, *(len(w.encode()) + 1 for w in words)])
    raw = np.frombuffer(text.encode(), np.uint8)
    _, starts, ends = C.passages(raw, np.array([0, len(raw)]), C.BITS, C.LEAST_RUN)
    tries = range(0, len(words) - 52, 7)
    for k in tries:
        lo, hi = int(at[k]) + gear.WINDOW, int(at[k + 51]) - 1
        first = np.searchsorted(starts, lo)
        hits += first < len(starts) and ends[first] <= hi
    assert hits / len(tries) >= 0.97


def test_texts_without_a_cut_and_a_very_long_one(spark):
    rng = random.Random(11)
    page = prose(rng, 3000)
    rows = [(1, "ab" * 2000), (2, "zz" + "ab" * 2000), (3, page * 60), (4, "x" + page)]
    got = {}
    for i, start, length, _ in runs_of(spark.createDataFrame(rows, "doc_id long, text string")):
        got[i] = got.get(i, 0) + length
    assert got[1] > 3000 and got[2] > 3000 and got[3] > 0.97 * len((page * 59).encode()) and got[4] > 0.97 * len(page.encode())
