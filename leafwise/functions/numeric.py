"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c, digits: int = 3) -> Column:
    """Banker's rounding, the rule of pandas/numpy ``round``."""
    return F.bround(_col(c), digits)


def round_fixed(c, digits: int = 6) -> Column:
    """``round(x * 10^d) / 10^d`` on the double itself.

    Used for results that are compared across engines: both sides round the
    same IEEE product, so decimal-string ties cannot split them.
    """
    scale = float(10**digits)
    return F.round(_col(c).cast("double") * scale) / scale


def safe_ratio(num, den, undefined=None) -> Column:
    """``num / den`` as double; ``undefined`` (NULL by default) when den = 0.

    ANSI mode raises on division by zero, so ``try_divide`` is used.
    """
    r = F.try_divide(_col(num).cast("double"), _col(den).cast("double"))
    return r if undefined is None else F.coalesce(r, F.lit(float(undefined)))
