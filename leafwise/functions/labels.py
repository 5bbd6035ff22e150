"""Label recoding, binarisation, validity and split routing (column functions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The two class names used by prediction files.
POSITIVE = "approved"
NEGATIVE = "unapproved"
# The three split suffixes of model file names.
SPLITS = {"_test": "test", "_val": "val", "_external": "external"}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def recode_label(c) -> Column:
    """``approved`` → 1.0, ``unapproved`` → 0.0, numeric text → its value,
    anything else → NULL (a column has one type, so junk cannot pass through)."""
    c = _col(c)
    return (
        F.when(c == POSITIVE, F.lit(1.0))
        .when(c == NEGATIVE, F.lit(0.0))
        .otherwise(c.try_cast("double"))
    )


def recode_labels(df: DataFrame, cols) -> DataFrame:
    """Apply :func:`recode_label` to each named column, keeping names."""
    return df.withColumns({c: recode_label(c) for c in cols})


def map_label(c) -> Column:
    """Strict map: ``unapproved`` → 0, ``approved`` → 1, anything else NULL."""
    c = _col(c)
    return F.when(c == NEGATIVE, F.lit(0)).when(c == POSITIVE, F.lit(1))


def binarize(c) -> Column:
    """``1`` if the value equals 1, else ``0`` (NULL and junk → 0)."""
    return F.coalesce((_col(c) == 1).cast("int"), F.lit(0))


def to_binary(c) -> Column:
    """Text or numeric label → 1/0, junk → NULL (text first, then number)."""
    c = _col(c)
    num = c.try_cast("double")
    return (
        F.when(c == POSITIVE, F.lit(1))
        .when(c == NEGATIVE, F.lit(0))
        .when(num == 1.0, F.lit(1))
        .when(num == 0.0, F.lit(0))
    )


def is_valid_prediction(c) -> Column:
    """Keep only the two class names (junk and NULL are dropped)."""
    return _col(c).isin(POSITIVE, NEGATIVE)


def split_of(model) -> Column:
    """``test`` / ``val`` / ``external`` from the model name's suffix, else NULL."""
    m = _col(model)
    out = None
    for suffix, name in SPLITS.items():
        out = F.when(m.endswith(suffix), F.lit(name)) if out is None else out.when(m.endswith(suffix), F.lit(name))
    return out
