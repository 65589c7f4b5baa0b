"""Joins that spread hot keys, and rows dealt by their number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one task sorts or hashes, about 30 MB of them.
TOGETHER = 1 << 18


def dealt_by_rows(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df` dealt by `keys` to as many tasks as `rows` rows need, however well these compress; what groups or joins by just these keys stays there."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TOGETHER)), *keys)


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int, most: int = 1000, least: int = 1000) -> DataFrame:
    """`rows` joined with `table`, which has each key once and in `count` its number of rows; `total` is their sum or more.

    A key that a good part of all rows have would bring them all to one task.  Keys with total / most rows or
    more are `most` in number at most, so their rows of `table` are broadcast; all others meet in a shuffle join.
    `least` keeps small keys out of the broadcast where there are few rows.  Null keys meet nothing.
    """
    bar = max(least, -(-total // most))
    hot = F.broadcast(table.where(F.col(count) >= bar))
    near = rows.join(hot, on)
    far = rows.join(hot.select(*on), on, "left_anti").join(table.where(F.col(count) < bar), on)
    return near.unionByName(far)
