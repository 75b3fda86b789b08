"""Numeric Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def safe_divide(num, den) -> Column:
    """division with NULL (not an error, not inf) for a zero denominator."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def pct_change(cur, prev) -> Column:
    """Relative change ``cur / prev - 1`` x 100; NULL when prev is 0 or NULL
    (the study turns +-inf into missing)."""
    return (F.try_divide(_c(cur).cast("double"), _c(prev).cast("double")) - F.lit(1.0)) * F.lit(100.0)


def null_double() -> Column:
    return F.lit(None).cast("double")
