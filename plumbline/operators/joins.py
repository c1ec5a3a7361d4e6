"""Joins whose hot keys don't meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this part of all rows, and from so many rows, on; so there are at most HOT_SHARE hot keys.
HOT_SHARE, HOT_ROWS = 1000, 20_000


def hot_join(rows: DataFrame, table: DataFrame, on: str, size: str, total: int, how: str = "left") -> DataFrame:
    """rows joined (left or inner) with `table`, which has each key `on` once and in `size` the number of rows that hold it.

    Hot keys, at most HOT_SHARE of them by their definition, are broadcast, so their rows stay where they are; all others meet
    by a shuffle in which no key has more than a HOT_SHARE-th of the rows. `size` is not kept. Null keys match nothing.
    """
    least = max(HOT_ROWS, total // HOT_SHARE)
    if total <= least:
        return rows.join(table.drop(size), on, how)
    hot = table.filter(F.col(size) >= least)
    warm = rows.join(F.broadcast(hot.drop(size)), on)
    cold = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(table.filter(F.col(size) < least).drop(size), on, how)
    return warm.unionByName(cold)
