"""Rounding, logits and small statistics as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_round(col, digits: int = 0) -> Column:
    """Round the exact binary value half to even, as Python's ``round`` does.

    The product with the power of ten is taken as an exact sum of two doubles, so
    values such as 2.675, which lie just below the decimal tie, go the right way.
    """
    x = _c(col).cast("double")
    scale = float(10 ** digits)
    split = x * 134217729.0
    high = split - (split - x)
    low = x - high
    product = x * scale
    error = (high * scale - product) + low * scale
    floor = F.floor(product).cast("double")
    past_half = product - floor - 0.5
    up = (
        F.when(past_half != 0, past_half > 0)
        .when(error != 0, error > 0)
        .otherwise(floor % 2 != 0)
    )
    return F.when(F.isnan(x), x).otherwise((floor + F.when(up, 1.0).otherwise(0.0)) / scale)


def np_round(col, digits: int = 0) -> Column:
    """Round the product with the power of ten half to even, as numpy and pandas do."""
    scale = float(10 ** digits)
    return F.rint(_c(col).cast("double") * scale) / scale


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Report form of a metric table: the named columns rounded."""
    return df.withColumns({c: py_round(c, d) for c, d in digits.items()})


def softmax(col) -> Column:
    """Softmax of an array of logits."""
    z = _c(col)
    top = F.array_max(z)
    exps = F.transform(z, lambda v: F.exp(v - top))
    total = F.aggregate(F.transform(z, lambda v: F.exp(v - top)), F.lit(0.0), lambda s, v: s + v)
    return F.transform(exps, lambda v: v / total)


def argmax(col) -> Column:
    """Zero-based position of the first maximum of an array."""
    z = _c(col)
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (rational Chebyshev fit, error below 1.2e-7 relative)."""
    # Coefficients of the fit, constant term first.
    coef = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
            0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(0.0)
    for c in reversed(coef):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0.0 when the whole is 0."""
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))
