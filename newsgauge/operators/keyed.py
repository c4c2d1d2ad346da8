"""One row, or the first k rows, per key.

All of these filter ``row_number() <= k``. Spark turns that into a group limit that runs before
the shuffle as well, so a key that holds a third of the rows ships k rows per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], k: int = 1,
               rank: str | None = None) -> DataFrame:
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def latest_rows(df: DataFrame, keys: Sequence[str | Column], ts: str, tie: Sequence[Column] = ()) -> DataFrame:
    return first_rows(df, keys, [F.col(ts).desc_nulls_last(), *tie])


def distinct_in_order(df: DataFrame, keys: Sequence[str | Column], position: Sequence[Column]) -> DataFrame:
    """Keeps the first occurrence of every key by an explicit arrival order."""
    return first_rows(df, keys, position)
