"""Ordering, long/wide reshaping and unions of report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_value(col: str, order: dict[str, int]) -> Column:
    """Look a name up in a literal order map; unmapped names give NULL."""
    if not order:
        return F.lit(None).cast("int")
    pairs = [x for k, v in order.items() for x in (F.lit(k), F.lit(int(v)))]
    return F.create_map(*pairs)[F.col(col)]


def rank_by_order(df: DataFrame, col: str, order: dict[str, int], by=(), rank_col: str = "sort_rank") -> DataFrame:
    """Add ``rank_col``: 1-based position within ``by`` under a user-given
    order map (unmapped names last, then by name).  Used on report tables
    (one row per model), so the window partitions are small."""
    key = order_value(col, order)
    w = Window.partitionBy(*by).orderBy(key.asc_nulls_last(), F.col(col).asc())
    return df.withColumn(rank_col, F.row_number().over(w))


def custom_order(df: DataFrame, col: str, order: dict[str, int], by=(), rank_col: str = "sort_rank") -> DataFrame:
    """Sort by a user-given order map; unmapped names last, then by name.

    The position is also emitted as ``rank_col``, so the order survives
    order-insensitive comparison and later shuffles.
    """
    return rank_by_order(df, col, order, by, rank_col).orderBy(*by, rank_col)


def ordered_category(col: str, categories: list[str]) -> Column:
    """1-based position of the value in ``categories``; others NULL."""
    arr = F.array(*[F.lit(c) for c in categories])
    return F.nullif(F.array_position(arr, F.col(col)).cast("int"), F.lit(0))


def melt(df: DataFrame, ids: list[str], values: list[str], var: str = "Metric", value: str = "Score") -> DataFrame:
    """Wide → long; NULL values are kept, like the reference."""
    return df.unpivot(ids, values, var, value)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Concatenate by column name; missing columns become NULL; duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
