"""Arithmetic that keeps missing values as NULL (never NaN or infinity)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a, b) -> Column:
    """a / b, NULL when b is zero (ANSI division would raise)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def safe_sqrt(x) -> Column:
    x = col(x)
    return F.when(x >= 0, F.sqrt(x))


def flag(cond: Column) -> Column:
    """1/0 integer of a condition; an unknown condition counts as 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def clean_double(x) -> Column:
    """NaN and infinities to NULL."""
    x = col(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def correlation(a, b) -> Column:
    """Pearson correlation over the rows that hold both (an aggregate); NULL where one has no spread.

    NaN and infinities are missing.  ``F.corr`` divides by zero there, which ANSI mode raises.
    """
    x, y = clean_double(a), clean_double(b)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def r6(x) -> Column:
    """Six places; halves and values a hair below go up, so that summation order cannot matter."""
    return F.floor(col(x).cast("double") * 1e6 + 0.5001) / F.lit(1e6)
