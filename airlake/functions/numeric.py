"""Small null-safe numeric expressions (ANSI mode raises on bad casts and zero divisors)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clamp; null stays null (``greatest`` alone would turn null into the bound)."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def div(a: Column, b: Column) -> Column:
    """Quotient, null where the divisor is zero or null."""
    return F.try_divide(a, b)


def to_double(c: Column) -> Column:
    """Text or number to double; unreadable text and NaN give null."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def logistic(x: Column, x0: float = 0.0, k: float = 1.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(float(k)) * (x - F.lit(float(x0)))))


def half_even(c: Column) -> Column:
    """Nearest integer, ties to even."""
    return F.bround(c, 0).cast("int")
