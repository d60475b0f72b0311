"""Document fingerprints by randomised edit embedding.

All texts share one random walk: at step j a text emits its current character and moves on
by a random bit that depends on j and that character only. Two texts
a few edits apart fall into step again soon after each edit, so their emitted strings
agree in most positions: edit distance becomes Hamming distance (Chakraborty,
Goldenberg and Koucky, 2016). A fingerprint samples positions of the emitted string.

Lengths differ by orders of magnitude, so samples come in levels: level l has ``SAMPLES`` fixed random
steps below 2**l. A text with a walk of about 2n steps carries its own level and
the one below, so that texts whose lengths differ by less than a factor of two share one.
Likeness is the share of equal samples of the common level, among those that either text reaches.

Pairs: bands of samples are the keys of an equi-join, candidates are verified by their edit
distance. See ``edit_links``.

Edge cases: null and empty texts have a fingerprint without samples, equal to each other with
likeness 1; rows are ordered by id, then text, nulls first, and the row after the last is the first; a
single row is its own next; repeated rows keep their rows; ids are whole numbers; an empty table gives no rows. Only the id and the text column are
read. A worker needs memory in proportion to the longest text.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps after which the shared random bits repeat.
PERIOD = 4096
#: Sampled steps of a level.
SAMPLES = 96
LEAST_LEVEL = 6
#: Bytes of text in a part of the documents that one task orders.
PART_BYTES = 12 << 20
#: Parts at most; larger inputs get larger parts, which are sorted on disk and read as a stream.
MOST_PARTS = 1 << 13
#: Cells of the table of characters that are walked over at once.
CELLS = 4 << 20
SEED = 20160619


@cache
def _dwell() -> np.ndarray:
    """For a character class and a step: how many steps until the walk moves on."""
    moves = np.random.default_rng(SEED).integers(0, 2, (256, PERIOD), dtype=np.uint8)
    moves[:, -1] = 1
    out = np.empty((256, PERIOD), np.int32)
    out[:, -1] = 1
    for j in range(PERIOD - 2, -1, -1):
        out[:, j] = np.where(moves[:, j] == 1, 1, out[:, j + 1] + 1)
    return out.ravel()


@cache
def steps_of(level: int) -> np.ndarray:
    """The sampled steps of a level, ascending."""
    return np.sort(np.random.default_rng((SEED, level)).integers(0, 1 << level, SAMPLES))


def level_of(n: int) -> int:
    return max(LEAST_LEVEL, (2 * n - 1).bit_length() if n else LEAST_LEVEL)


def _classes(points: np.ndarray) -> np.ndarray:
    return np.where(points < 128, points, (points * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _sample_bytes(points: np.ndarray) -> np.ndarray:
    return ((points * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint16) % 255 + 1


def embed(texts: list[str]) -> list[bytes]:
    """The fingerprint of each text: its level, then the samples of that level and of the one below; 0: beyond its end."""
    dwell, out = _dwell(), [b""] * len(texts)
    points = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points], np.int64)
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(order):
        longest = int(sizes[order[at]])
        rows = order[at : at + max(1, CELLS // max(1, longest))]
        at += len(rows)
        table = np.zeros((len(rows), longest), np.int32)
        for r, i in enumerate(rows.tolist()):
            table[r, : sizes[i]] = _classes(points[i])
        table = np.ascontiguousarray(table.T) * PERIOD
        step = np.zeros((longest + 1, len(rows)), np.int32)
        active = np.searchsorted(-sizes[rows], -np.arange(longest), side="left").tolist()
        for p in range(longest):
            a = active[p]
            now = step[p, :a]
            np.add(now, dwell.take(table[p, :a] + (now & (PERIOD - 1))), out=step[p + 1, :a])
        step = np.ascontiguousarray(step.T)
        for r, i in enumerate(rows.tolist()):
            n = int(sizes[i])
            level = level_of(n)
            samples = np.concatenate((steps_of(level), steps_of(level - 1)))
            where = np.searchsorted(step[r, : n + 1], samples, side="right") - 1
            found = np.zeros(len(samples), np.uint16)
            inside = where < n
            if n:
                found[inside] = _sample_bytes(points[i][where[inside]])
            out[i] = bytes([level]) + found.astype(np.uint8).tobytes()
    return out


def likeness(a: bytes, b: bytes) -> float:
    """Estimated share of equal emitted characters, 0 to 1."""
    if a == b:
        return 1.0
    if abs(a[0] - b[0]) > 1:
        return 0.0
    level = min(a[0], b[0])
    x, y = (np.frombuffer(f[1 : 1 + SAMPLES] if f[0] == level else f[1 + SAMPLES :], np.uint8) for f in (a, b))
    either = (x | y) > 0
    return float((x == y)[either].mean()) if either.any() else 1.0


def _place(bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are below the id; by groups of about the root of their number."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    every, ends = F.lit(np.array(bounds, np.int64)), F.lit(np.array(bounds[width - 1 :: width], np.int64))
    group = F.size(F.filter(ends, lambda b: b < F.col("id"))) * width
    return group + F.size(F.filter(F.slice(every, group + 1, width), lambda b: b < F.col("id")))


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, after, id, text): parts in the order of ids; with ``after``, the first row of the next part."""
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MOST_PARTS, max(1, -(-size // PART_BYTES)))
    bounds = []
    if parts > 1:
        bounds = kept.agg(F.percentile_approx("id", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10_000)).first()[0]
        bounds = sorted(set(bounds or []))
    kept = kept.withColumn("part", F.when(F.col("id").isNull(), 0).otherwise(_place(bounds)))
    firsts = {r["part"]: r for r in kept.groupBy("part").agg(F.min("id").alias("least"), F.count_if(F.col("id").isNull()).alias("nulls")).collect()}
    order = sorted(firsts)
    before = dict(zip(order, [*order[-1:], *order[:-1]], strict=True))
    least = np.array([firsts[p]["least"] or 0 if p in firsts else 0 for p in range(len(bounds) + 1)], np.int64)
    to = np.array([before.get(p, 0) for p in range(len(bounds) + 1)], np.int32)
    # nulls come first, so that they are the first rows of their part
    null_first = any(firsts[p]["nulls"] for p in order)
    first = (F.col("id").isNull() if null_first else F.lit(False)) | (F.col("id") == F.element_at(F.lit(least), F.col("part") + 1)) & ~((F.col("part") == 0) & F.lit(null_first))
    own = F.struct("part", F.lit(False).alias("after"))
    again = F.struct(F.element_at(F.lit(to), F.col("part") + 1).alias("part"), F.lit(True).alias("after"))
    spread = kept.withColumn("p", F.explode(F.when(first, F.array(own, again)).otherwise(F.array(own)))).select("p.part", "p.after", "id", "text")
    return spread.repartition(max(1, len(order)), "part").sortWithinPartitions("part", "after", F.asc_nulls_first("id"), F.asc_nulls_first("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has its last half replaced by the beginning of the next row's text.
    """

    def results(rows: list[tuple]) -> pa.RecordBatch:
        """Of all rows but the last, which is next to the one before it."""
        texts = [t for _, _, t in rows]
        halves = [len(t) // 2 for t in texts]
        edited = [t[: len(t) - h] + after[:h] for t, h, after in zip(texts, halves, texts[1:], strict=False)]
        marks = embed(texts + edited)
        own, changed = marks[: len(texts)], marks[len(texts) :]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for _, i, _ in rows[:-1]], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array([m.hex() for m in own[:-1]]),
                pa.array([m.hex() for m in changed]),
                pa.array([likeness(a, b) for a, b in zip(own, changed, strict=False)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
            ],
            [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        size = 0
        done = None
        for batch in batches:
            for part, after, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part == done:  # a further row with the id of the next part's first
                    continue
                waiting.append((part, i, text))
                size += len(text)
                if after or size > PART_BYTES // 2:
                    if len(waiting) > 1:
                        yield results(waiting)
                    waiting, size = ([], 0) if after else (waiting[-1:], len(text))
                    done = part if after else None

    schema = f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _ordered(docs, id_col, text_col).mapInArrow(run, schema)


def band_keys(fingerprint: bytes, bands: int, width: int) -> list[str]:
    """Keys of the bands: ``width`` samples each, drawn from all of a level, for the text's own level and the one below.

    Bands that hold nothing but positions beyond the text's end are left out.
    """
    keys = []
    for down in (0, 1):
        level = fingerprint[0] - down
        samples = fingerprint[1 + down * SAMPLES : 1 + (down + 1) * SAMPLES]
        for b in range(bands):
            picked = bytes(samples[k] for k in np.random.default_rng((SEED, level, b)).choice(SAMPLES, width, replace=False))
            if any(picked):
                keys.append(f"{level}:{b}:{picked.hex()}")
    return keys


def edit_links(docs: DataFrame, most_edits: int, id_col: str = "doc_id", text_col: str = "text", bands: int = 12, width: int = 4, block_rows: int = 256) -> DataFrame:
    """(a, b): enough pairs of ids within ``most_edits`` edits, among those that share a band, to connect all of them.

    Equal texts are linked to the least id among them. Members of a band are compared in blocks of bounded size, a block with
    each block; a unit reports a spanning forest.
    """
    kept = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    each = kept.groupBy("text").agg(F.min("id").alias("id"))
    equal = kept.withColumnRenamed("id", "b").join(each.withColumnRenamed("id", "a"), "text").where("a < b").select("a", "b")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [band_keys(f, bands, width) for f in embed(texts)]
            n = [len(k) for k in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array([k for ks in found for k in ks], pa.string())], ["id", "band"])

    banded = each.select("id", "text").mapInArrow(keys, "id long, band string")
    sizes = banded.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    placed = banded.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    with_all = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    units = placed.select("band", "block", "id", F.explode(with_all).alias("u")).select("band", "u.i", "u.j", "block", "id").join(each, "id")

    def compare(rows):
        ids, texts, block = rows["id"].tolist(), rows["text"].tolist(), rows["block"].tolist()
        up, left, right = list(range(len(ids))), [], []

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        same = rows["i"].iat[0] == rows["j"].iat[0]
        for x in range(len(ids)):
            for y in range(x):
                if (same or block[x] != block[y]) and root(x) != root(y) and within(texts[x], texts[y], most_edits):
                    up[root(x)] = root(y)
                    left.append(min(ids[x], ids[y]))
                    right.append(max(ids[x], ids[y]))
        return pd.DataFrame({"a": left, "b": right}, dtype="int64")

    return equal.union(units.groupBy("band", "i", "j").applyInPandas(compare, "a long, b long")).distinct()


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is ``most`` at most; by furthest-reaching diagonals, O(most * length)."""
    if abs(len(a) - len(b)) > most:
        return False
    goal, reach = len(b) - len(a), {0: 0}

    def slide(i: int, d: int) -> int:
        low, high = 0, min(len(a) - i, len(b) - i - d)
        if high <= 0 or a[i : i + high] == b[i + d : i + d + high]:
            return i + max(0, high)
        return i + bisect.bisect_left(range(low, high), True, key=lambda k: a[i : i + k + 1] != b[i + d : i + d + k + 1])

    reach = {0: slide(0, 0)}
    for _ in range(most + 1):
        if reach.get(goal, -1) >= len(a):
            return True
        grown: dict[int, int] = {}
        for d, i in reach.items():
            for nd, ni in ((d, i + 1), (d - 1, i + 1), (d + 1, i)):
                if ni <= len(a) and 0 <= ni + nd <= len(b):
                    grown[nd] = max(grown.get(nd, -1), ni)
        reach = {d: slide(i, d) for d, i in grown.items()}
    return False
