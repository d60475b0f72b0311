"""Near-duplicates by SimHash, found with BK-trees.

A text's fingerprint has a bit set where over half of its shingle hashes have
it set. Fingerprints within ``radius`` bits are linked; components of links are
groups of near-duplicates.

Search: the 64 bits are cut into ``m`` blocks. Two fingerprints that differ in at
most ``radius`` bits agree in ``m - radius`` blocks at least, so each such choice
of blocks is a shard key, and no link is lost. Within a shard, fingerprints form a
BK-tree: the children of a node are keyed by their Hamming distance to it, and a
search follows only the edges within the radius. Shards beyond ``shard_rows``
are cut into parts; every part's tree meets the queries of every part, in
units of bounded size. Trees travel to their queries by a shuffle: their sum grows with the
corpus, so that a broadcast of all of them would have no bound.

A unit reports a spanning forest of its links, not all pairs, so a group of n
copies costs n rows. Components run over distinct fingerprints.

Edge cases: null and empty texts have no words and fingerprint zero; fewer than
``size`` words make one shingle; repeated rows keep their rows; a null document id
is kept, and gets the least id of its group; an empty table gives no rows.
Only the id and the text column are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import Words, slices
from tessera.operators.components import connected_components
from tessera.operators.storage import materialize

#: Fingerprints that a shard's tree holds at most.
SHARD_ROWS = 4096


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of all shingles, and the first of each text with their number."""
    text, begins, ends = words.spaced()
    counts = np.diff(words.docs)
    per_doc = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    firsts = np.concatenate(([0], np.cumsum(per_doc)))
    index = np.arange(firsts[-1]) + np.repeat(words.docs[:-1] - firsts[:-1], per_doc)
    last = np.minimum(index + size, np.repeat(words.docs[1:], per_doc)) - 1
    digest = xxhash.xxh64_intdigest
    pairs = zip(begins[index].tolist(), ends[last].tolist(), strict=True)
    return np.fromiter((digest(text[a:b], 42) for a, b in pairs), np.uint64, len(index)), firsts


def majority(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Of each text, the bits set in over half its hashes."""
    n = np.diff(firsts)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    total = np.zeros((len(some), 64), np.int64)
    heads, step, at = firsts[:-1][some], 1 << 16, 0
    while at < len(hashes):
        to = min(len(hashes), at + step)
        bits = np.unpackbits(hashes[at:to].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        lo, hi = np.searchsorted(heads, at, side="right") - 1, np.searchsorted(heads, to, side="left")
        cuts = np.maximum(heads[lo:hi], at) - at
        total[lo:hi] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
        at = to
    over = (2 * total > n[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(over, axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(id, fp): the SimHash of each text as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                fp = majority(*shingle_hashes(Words(texts), size))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, fp long")


class BKTree:
    """Distinct values under the Hamming distance."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            child = node[1].get(d)
            if child is None:
                node[1][d] = [value, {}]
                return
            node = child

    def near(self, value: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            here, children = todo.pop()
            d = (here ^ value).bit_count()
            if d <= radius:
                found.append(here)
            if children:
                low, high = d - radius, d + radius
                todo += [child for key, child in children.items() if low <= key <= high]
        return found

    def near_then_add(self, value: int, radius: int) -> list[int]:
        """``near``, then ``add``, in one walk: the place of a value is always on the way of its search."""
        if self.root is None:
            self.root = [value, {}]
            return []
        found, todo, path = [], [self.root], self.root
        while todo:
            node = todo.pop()
            here, children = node
            d = (here ^ value).bit_count()
            if d <= radius:
                found.append(here)
            if children:
                low, high = d - radius, d + radius
                todo += [child for key, child in children.items() if low <= key <= high]
            if node is path and d:
                path = children.get(d)
                if path is None:
                    children[d] = [value, {}]
        return found


def block_masks(n: int, radius: int, shard_rows: int = SHARD_ROWS) -> list[int]:
    """Bit masks of the shard keys: the fewest blocks that leave about ``shard_rows`` / 2 of ``n`` values to a shard."""
    for m in range(radius + 1, 17):
        edges = [round(i * 64 / m) for i in range(m + 1)]
        blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        if n <= (shard_rows // 2) << ((m - radius) * (64 // m)) or m == 16:
            return [sum(c) for c in combinations(blocks, m - radius)]
    raise AssertionError


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _units(values: DataFrame, shards: list[Column], shard_rows: int) -> DataFrame:
    """(unit, role, ...): in a unit, rows of role 0 build the tree, 1 ask, 2 do both.

    A shard is named by a hash of its table and key; where two hashes are equal their trees are one, which adds questions and loses
    nothing. Part i of a crowded shard is a tree that meets the parts from i on.
    """
    kept = values.columns
    names = [F.xxhash64(F.lit(t), key) for t, key in enumerate(shards)]
    keyed = values.select(*kept, F.explode(F.array(*names)).alias("shard"))
    large = keyed.groupBy("shard").count().where(F.col("count") > shard_rows).select("shard", F.ceil(F.col("count") / shard_rows).cast("int").alias("parts"))
    keyed = keyed.join(large, "shard", "left")
    parts = F.col("parts")
    part = F.pmod(F.xxhash64(F.col(kept[-1])), parts).cast("int")

    def unit(i: Column, j: Column, role: Column) -> Column:
        return F.struct(F.xxhash64(F.col("shard"), i, j).alias("unit"), role.cast("byte").alias("role"))

    as_tree = F.transform(F.sequence(part, parts - 1), lambda j: unit(part, j, F.when(j == part, 2).otherwise(0)))
    as_query = F.transform(F.sequence(F.lit(1), part), lambda i: unit(i - 1, part, F.lit(1)))
    whole = F.array(F.struct(F.col("shard").alias("unit"), F.lit(2).cast("byte").alias("role")))
    roles = F.when(parts.isNull(), whole).when(part > 0, F.concat(as_tree, as_query)).otherwise(as_tree)
    return keyed.select(*kept, F.explode(roles).alias("r")).select("r.unit", "r.role", *kept)


def tree_links(units: DataFrame, radius: int) -> DataFrame:
    """(a, b): enough pairs of nodes within ``radius`` bits of each other to connect all that a unit links.

    ``units``: unit, role and fingerprint, which names the node; or unit, role, both halves of a fingerprint of 128 bits, and the node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, tree, parent, name = None, BKTree(), {}, {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for batch in batches:
            if not len(batch):
                continue
            left, right = [], []
            keys = batch.column(0).to_numpy()
            begins = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(batch)])).tolist()
            roles, fps, nodes = (batch.column(k).to_pylist() for k in (1, 2, len(batch.columns) - 1))
            if len(batch.columns) > 3:
                fps = [(high & 0xFFFFFFFFFFFFFFFF) << 64 | (low & 0xFFFFFFFFFFFFFFFF) for high, low in zip(fps, batch.column(3).to_pylist(), strict=True)]
            else:
                fps = [fp & 0xFFFFFFFFFFFFFFFF for fp in fps]
            for at, to in zip(begins, begins[1:], strict=False):
                if (here := keys[at]) != unit:
                    unit = here
                    if to - at == 1 and to < len(batch):  # alone in its unit
                        continue
                    tree, parent, name = BKTree(), {}, {}
                for k in range(at, to):
                    role, node, value = roles[k], nodes[k], fps[k]
                    if role == 0:
                        tree.add(value)
                        found = [value] if name.setdefault(value, node) != node else []
                    else:
                        known = value in name
                        found = tree.near(value, radius) if role == 1 or known else tree.near_then_add(value, radius)
                        if role == 2 and not known:
                            name[value] = node
                    for other in found:
                        if (r := root(name[other])) != (mine := root(node)):
                            parent[r] = mine
                            left.append(node)
                            right.append(name[other])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return units.repartition("unit").sortWithinPartitions("unit", "role", "fp").mapInArrow(run, "a long, b long")


def links(values: DataFrame, radius: int = 4, shard_rows: int = SHARD_ROWS, n: int | None = None) -> DataFrame:
    """(a, b): enough pairs of distinct ``fp`` within ``radius`` bits to connect all that are linked."""
    n = values.count() if n is None else n
    shards = [F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in block_masks(n, radius, shard_rows)]
    return tree_links(_units(values.select("fp"), shards, shard_rows), radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id_col, fingerprint, component_id) of every row; component_id: the least id reachable by links."""
    marked = materialize(fingerprints(docs, id_col, text_col, size), "fingerprints")
    values = materialize(marked.groupBy("fp").agg(F.min("id").alias("least")), "values")
    graph = connected_components(links(values.select("fp"), radius, shard_rows)).withColumnRenamed("node", "fp")
    graph = materialize(values.join(graph, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "graph")
    least = graph.groupBy("component").agg(F.min("least").alias("component_id"))
    named = graph.join(least, "component").select("fp", "component_id")
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(named, "fp").select(F.col("id").alias(id_col), fingerprint.alias("fingerprint"), "component_id")
