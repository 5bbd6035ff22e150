"""Integer vectors from float arrays, and sums of arrays over all rows: shared by the vector operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True when the array is there and none of its components is NULL, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def floored(vector: Column, scale: int, limit: int) -> Column:
    """floor(scale * x) of every component, x as double; a component of ``limit`` or more raises an error.

    Beyond the limit squared distances would leave the range of a long.
    """
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    wide = F.exists(vector, lambda x: F.abs(x.cast("double") * scale) >= limit)
    return F.when(wide, F.raise_error(F.lit(f"vector component beyond {limit} / {scale}"))).otherwise(ints)


def summed(rows: DataFrame, column: str, how=F.sum) -> dict[int, int]:
    """Componentwise total of an array column over all rows, by position (as many values as the arrays are long)."""
    got = rows.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(how("x").alias("x"))
    return {r["at"]: r["x"] for r in got.collect()}


def list_of(values, type_: pa.DataType) -> pa.Array:
    """An Arrow column of one list."""
    return pa.array([values], type=pa.list_(type_))
