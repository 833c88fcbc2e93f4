"""Generic Column helpers shared by the operators.

All of them are plain Catalyst expressions, so they stay inside whole-stage
codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """``num / den`` with NULL for a zero or NULL divisor (ANSI ``/`` raises)."""
    return F.try_divide(col(num), col(den))


def ieee_div(num, den) -> Column:
    """Division with IEEE results on a zero divisor: +-inf, and NULL for 0/0.

    Threshold tests such as ``abs(z) >= 2`` treat an infinite ratio as a hit,
    as float arithmetic does; ``safe_div`` would silently drop it.
    """
    n, d = col(num), col(den)
    return (F.when(d.isNull() | n.isNull(), F.lit(None).cast("double"))
            .when(d != 0, n / d)
            .when(n > 0, F.lit(INF))
            .when(n < 0, F.lit(-INF))
            .otherwise(F.lit(None).cast("double")))


def is_finite(c) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(INF))


def nan_to_null(c) -> Column:
    """NaN and +-inf become NULL (NaN compares greater than everything in Spark)."""
    c = col(c)
    return F.when(is_finite(c), c)


def rolling(agg_fn, c, window, min_periods: int) -> Column:
    """A windowed aggregate that is NULL until ``min_periods`` non-null values are in the frame."""
    c = col(c)
    return F.when(F.count(c).over(window) >= min_periods, agg_fn(c).over(window))


def stable_round(c, scale: int = 6) -> Column:
    """Round half away from zero, robust to last-bit noise.

    The value is first snapped to ``scale + 3`` decimals through DECIMAL, so two
    engines that summed in different orders (…49999 vs …50001 at a tie) agree;
    non-finite values pass through unchanged.
    """
    c = col(c).cast("double")
    snapped = c.cast(f"decimal(38,{scale + 3})").cast(f"decimal(38,{scale})").cast("double")
    return F.when(is_finite(c), snapped).otherwise(c)


def round_doubles(df: DataFrame, scale: int = 6) -> DataFrame:
    """Round every float/double column (used where results are compared or exported)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(stable_round(f.name, scale).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
