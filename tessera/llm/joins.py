"""A join that no frequent key can crowd."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast at most: those of more than this part of all rows.
HOT_KEYS = 10_000


def join_counted(left: DataFrame, right: DataFrame, on: list[str], hot_keys: int = HOT_KEYS) -> DataFrame:
    """The inner join with ``right``, whose keys are unique and whose ``n`` says how many rows of ``left`` have each; ``n`` is dropped.

    Keys that more than 1 / ``hot_keys`` of all these rows have are fewer than ``hot_keys`` by arithmetic, whatever the size of the
    data. They are broadcast, so that their rows stay where they are; all others are joined by a shuffle.
    """
    limit = (right.agg(F.sum("n")).first()[0] or 0) / hot_keys
    hot, cold = F.broadcast(right.where(F.col("n") > limit).drop("n")), right.where(F.col("n") <= limit).drop("n")
    return left.join(hot, on).unionByName(left.join(hot, on, "left_anti").join(cold, on))
