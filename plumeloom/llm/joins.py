"""Joins that stay spread over tasks whatever share of the rows one key has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that more than one in so many rows have are hot; so there are at most so many.
MOST_HOT = 10_000


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of rows with a table that has one row per key and, in count, the key's rows.

    Hot keys, at most MOST_HOT, are broadcast, so their rows stay where they are; for the others,
    each at most 1 / MOST_HOT of the rows, the join is Spark's choice. Null keys match nothing.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(table.filter(F.col(count) * MOST_HOT > total))
    cold = table.filter(F.col(count) * MOST_HOT <= total)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))
