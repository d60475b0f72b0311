"""Near-duplicates by SimHash whose links are verified by the exact similarity of their shingle sets.

Texts are linked where the Jaccard similarity of their sets of word shingles is ``least`` or more; components of links are
groups of near-duplicates. At a similarity of 0.8 SimHashes differ in about 10 of 64 bits, too many for the exact
search by agreeing blocks, so shards are sampled: each table takes some bits of one of three SimHash words as its shard
key, and in a shard the BK-tree of fingerprints of 128 bits is searched with a radius of 32 bits, which two unrelated texts
meet once in 10^8 times. The bits of a key follow the number
of texts, so that a shard holds about ``FILL`` of them, and the tables follow the bits, so that a pair at ``least`` is found with a probability
of ``RECALL`` (``tables_for``), a closer one with more: 0.99 from 0.85 on.

Candidates only name clusters: members of one are compared by their whole sets until each is
connected or differs from all others; none is left out. Large clusters are cut into parts, and
every part meets every part, in units of bounded size. A unit reports a spanning forest of its links, so a group of n copies
costs n rows. Equal sets are one node.

The tables grow with the number of texts, about as n to the power of 0.35 to 0.45: 48 for 2 * 10^5 texts, 165 for 10^7, 1311 for 10^9.

Edge cases: null and empty texts have equal, empty sets; fewer than ``size`` words make one
shingle; repeated rows keep their rows; a null id gets the least id of its group; an
empty table gives no rows. Only the id and the text column are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import acos, comb, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.simhash_bk import SHARD_ROWS, _signed, _units, majority, shingle_hashes, tree_links
from tessera.llm.text import Words, slices
from tessera.operators.components import connected_components
from tessera.operators.storage import materialize

#: Words of a shingle, and similarity of a link at least.
SIZE, LEAST = 5, 0.8
#: Texts of a shard on average, and share of the pairs at the least similarity to find.
FILL, RECALL = 32, 0.98
#: SimHash words that shard keys are taken from.
WORDS = 3
#: Bytes of text that are sketched at once.
SLICE = 1 << 20
#: Texts and shingles of a part of a cluster, on average at most.
PART_ROWS, PART_SHINGLES = 4096, 1 << 20

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _differ(similarity: float) -> float:
    """Share of SimHash bits in which two sets of this Jaccard similarity and of one size differ."""
    return acos(2 * similarity / (1 + similarity)) / pi


def radius_for(least: float) -> int:
    """Bits of 128 between the SimHashes of candidates at most: 3.2 deviations above what pairs at ``least`` have on average."""
    differ = _differ(least)
    return int(128 * differ + 3.2 * (128 * differ * (1 - differ)) ** 0.5)


def expected_recall(bits: int, tables: int, least: float) -> float:
    """Probability that two sets of this similarity and of one size share a shard and are within the radius."""
    differ = _differ(least)
    of_bits = [comb(64, d) * differ**d * (1 - differ) ** (64 - d) for d in range(65)]
    agree = [comb(64 - d, bits) / comb(64, bits) for d in range(65)]
    miss = 1.0
    for w in range(WORDS):
        n = tables // WORDS + (w < tables % WORDS)
        miss *= sum(p * (1 - a) ** n for p, a in zip(of_bits, agree, strict=True))
    return (1 - miss) * sum(comb(128, d) * differ**d * (1 - differ) ** (128 - d) for d in range(radius_for(least) + 1))


@cache
def tables_for(n: int, least: float = LEAST) -> list[tuple[int, int]]:
    """(word, bit mask) of each table for ``n`` texts."""
    bits = max(6, min(40, round(log2(max(n, 1) / FILL)))) if n > FILL else 6
    tables = WORDS
    while expected_recall(bits, tables, least) < RECALL:
        tables += WORDS
    rng = np.random.default_rng(bits)
    return [(t % WORDS, sum(1 << int(b) for b in rng.choice(64, bits, replace=False))) for t in range(tables)]


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and the first of each text with their number."""
    hashes, firsts = shingle_hashes(Words(texts), size)
    doc = np.repeat(np.arange(len(texts)), np.diff(firsts))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def words_of_bits(hashes: np.ndarray, firsts: np.ndarray) -> list[np.ndarray]:
    """The SimHash of each set, and as many further ones from mixed hashes."""
    mixed = [hashes]
    for odd in _MIX:
        h = (hashes ^ (hashes >> np.uint64(31))) * odd
        mixed.append((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
    return [majority(h, firsts) for h in mixed]


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, tie, key, n, fp, w0, w1, w2) of each row; tie: digest of the text, key: digest of its set, n: shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for rows, texts in slices(batch, "text", SLICE):
                hashes, firsts = shingle_sets(texts, size)
                bounds = firsts.tolist()
                keys = np.fromiter((digest(hashes[a:b].tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)), np.uint64, len(texts))
                words = [pa.array(w.view(np.int64)) for w in words_of_bits(hashes, firsts)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(keys.view(np.int64)), pa.array(np.diff(firsts)), *words], ["id", "tie", "key", "n", "fp", "w0", "w1", "w2"])

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _tie(text_col).alias("tie"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, tie binary, key long, n long, fp long, w0 long, w1 long, w2 long")


def _tie(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def clusters(values: DataFrame, least: float) -> DataFrame:
    """(key, cluster) of the sets that have a candidate."""
    shards = [F.col(f"w{w}").bitwiseAND(F.lit(_signed(mask))) for w, mask in tables_for(values.count(), least)]
    units = _units(values.select("w0", "w1", "w2", "fp", "key"), shards, SHARD_ROWS).select("unit", "role", "fp", "w0", "key")
    return connected_components(tree_links(units, radius_for(least))).select(F.col("node").alias("key"), F.col("component").alias("bucket"))


def _met(members: DataFrame, part_rows: int) -> DataFrame:
    """(bucket, i, j, role, key): part i meets part j; role 0 is met, 1 meets, 2 does both."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    parts = F.greatest(F.ceil(F.col("c") / part_rows), F.ceil(F.col("s") / PART_SHINGLES)).cast("int")
    keyed = members.join(sizes.select("bucket", parts.alias("parts")), "bucket").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    as_met = F.transform(F.sequence(F.col("part"), F.col("parts") - 1), lambda j: F.struct(F.col("part").alias("i"), j.alias("j"), F.when(j == F.col("part"), 2).otherwise(0).alias("role")))
    as_meeting = F.transform(F.sequence(F.lit(0), F.col("part") - 1), lambda i: F.struct(i.alias("i"), F.col("part").alias("j"), F.lit(1).alias("role")))
    roles = F.when(F.col("part") > 0, F.concat(as_met, as_meeting)).otherwise(as_met)
    return keyed.select("bucket", "key", F.explode(roles).alias("r")).select("bucket", "r.i", "r.j", "r.role", "key")


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two ascending arrays without repeats have the Jaccard similarity ``least``."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return False
    both = np.sort(np.concatenate((a, b)), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= least * (small + large - common)


def links(units: DataFrame, size: int, least: float) -> DataFrame:
    """(a, b): enough pairs of alike sets to connect all that a unit links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, groups = None, []
        for batch in batches:
            left, right = [], []
            for rows, texts in slices(batch, "text", SLICE):
                hashes, firsts = shingle_sets(texts, size)
                columns = [rows.column(k).to_pylist() for k in range(5)]
                for at, (*here, role, key) in enumerate(zip(*columns, strict=True)):
                    if here != unit:
                        unit, groups = here, []
                    mine = hashes[firsts[at] : firsts[at + 1]].copy()
                    joined, others = [], []
                    for group in groups if role else []:
                        other = next((k for k, x in group if alike(mine, x, least)), None)
                        if other is None:
                            others.append(group)
                        else:
                            joined += group
                            left.append(key)
                            right.append(other)
                    if role:
                        groups = [*others, joined] if joined else others
                    if role != 1:
                        if joined:
                            joined.append((key, mine))
                        else:
                            groups.append([(key, mine)])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    unit = ["bucket", "i", "j"]
    return units.repartition(*unit).sortWithinPartitions(*unit, "role", "key").select(*unit, "role", "key", "text").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, least: float = LEAST, part_rows: int = PART_ROWS) -> DataFrame:
    """(id_col, component_id) of every row; component_id: the least id reachable by links."""
    marked = materialize(sketches(docs, id_col, text_col, size), "sketches")
    values = marked.groupBy("key").agg(F.min("id").alias("least"), F.min("tie").alias("tie"), *[F.first(c).alias(c) for c in ("n", "fp", "w0", "w1", "w2")])
    values = materialize(values, "values")
    members = values.select("key", "n").join(clusters(values, least), "key")
    units = materialize(_met(members, part_rows), "units")
    wanted = units.select("key").distinct().join(values.select("key", "tie"), "key")
    texts = docs.select(_tie(text_col).alias("tie"), F.col(text_col).alias("text")).join(wanted, "tie").dropDuplicates(["tie"]).select("key", "text")
    graph = connected_components(links(units.join(texts, "key"), size, least)).withColumnRenamed("node", "key")
    graph = materialize(values.join(graph, "key", "left").select("key", "least", F.coalesce("component", "key").alias("component")), "graph")
    lowest = graph.groupBy("component").agg(F.min("least").alias("component_id"))
    named = graph.join(lowest, "component").select("key", "component_id")
    return marked.join(named, "key").select(F.col("id").alias(id_col), "component_id")
