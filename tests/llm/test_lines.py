"""Line deduplication against a search for every earlier run."""

import random
import time

import pytest

from tessera.llm import line_winnow


def plain(texts, least):
    """The kept text of each, by the definition: any earlier run of equal lines with enough characters, over all pairs."""
    filled = [[(i, line) for i, line in enumerate(t.split("\n")) if line.strip(" ")] for t in texts]
    out = []
    for d, text in enumerate(texts):
        dead = set()
        for f in range(d + 1):
            for shift in range(-len(filled[f]), len(filled[d]) + 1):  # line k here, line k - shift there
                if f == d and shift <= 0:
                    continue
                run = []
                for k in range(len(filled[d]) + 1):
                    same = k < len(filled[d]) and 0 <= k - shift < len(filled[f]) and filled[d][k][1] == filled[f][k - shift][1]
                    if same:
                        run.append(k)
                        continue
                    if sum(len(filled[d][r][1]) for r in run) >= least:
                        dead |= {filled[d][r][0] for r in run}
                    run = []
        kept, gone = [], False
        for i, line in enumerate(text.split("\n")):
            gone = i in dead if line.strip(" ") else gone
            if not gone:
                kept.append(line)
        out.append("\n".join(kept))
    return out


def cleaned(spark, texts, **options):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in line_winnow.deduplicated(frame, **options).orderBy("doc_id").collect()]


@pytest.mark.parametrize(("least", "block"), [(1, 4096), (7, 3), (20, 4096), (33, 5)])
def test_every_earlier_run_is_found(spark, least, block):
    rng = random.Random(least)
    pool = ["}", "", "---", "a", "bb b", "return x", "    pass", "a line of twenty-odd letters", " ", "é中"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 25))) for _ in range(25)]
    want = plain(texts, least)
    assert cleaned(spark, texts, least_chars=least, block_lines=block) == want and want != texts


def test_a_common_line_does_not_hide_a_run(spark):
    """The run of the second and third text is found though each of its lines also stands alone in an earlier text."""
    run = [f"line {i} of a run that the second and the third text share, and that is long enough" for i in range(3)]
    texts = [f"one\n{run[0]}\ntwo\n{run[1]}\nthree\n{run[2]}", "\n".join(["start", *run, "end"]), "\n".join(["other start", *run, "other end"])]
    assert cleaned(spark, texts, least_chars=200) == [texts[0], texts[1], "other start\nother end"]


def test_one_long_line_is_a_run(spark):
    line = "a single line of more than one hundred characters that stands in two texts with nothing else in common, " * 2
    assert cleaned(spark, [f"a\n{line}\nb", f"c\nd\n{line}\n\ne"]) == [f"a\n{line}\nb", "c\nd\ne"]


def test_ids_of_other_types(spark):
    line = "x" * 120
    frame = spark.createDataFrame([("b", line), ("a", line), (None, line), ("a", None)], "name string, body string")
    got = {(r["name"], r["body"]) for r in line_winnow.deduplicated(frame, "name", "body").collect()}
    assert got == {("b", ""), ("a", line), (None, ""), ("a", None)}


def test_a_text_of_very_many_short_lines_is_linear(spark):
    """One megabyte of which every other line is a bracket."""
    rng = random.Random(5)
    text = "\n".join("}" if i % 2 else f"    call({rng.randrange(10**9)})" for i in range(95_000))
    began = time.time()
    assert cleaned(spark, [text, text[:5000]])[0] == text
    assert len(text) > 1_000_000 and time.time() - began < 20
