"""Connected components by alternating large-star and small-star rounds.

Each round replaces edges so that every node points at the least node it knows
of (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014). The
minimum per node is a partial aggregate, so a hub's edges are never gathered in
one place. The result labels a component with its least member.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.storage import checkpointed


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.join(_least(both).withColumn("least", F.least("least", "u")), "u")
    return near.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    near = edges.join(_least(edges), "u")
    moved = near.select(F.col("v").alias("u"), F.col("least").alias("v"))
    kept = near.select("u", F.col("least").alias("v"))
    return moved.union(kept).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another node.

    ``component`` is the least node of the component. Edges may repeat, point
    either way or join a node to itself; rows with a null end are no edges. Nodes
    without an edge to another are left out: they are their own component.
    """
    edges = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"), F.col(left).alias("l"), F.col(right).alias("r"))
    edges = checkpointed(edges.where("l is not null and r is not null and u <> v").select("u", "v").distinct())
    before = _state(edges)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        edges = checkpointed(_small_star(_large_star(edges)))
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
