"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def half_even(value: Column, digits: int) -> Column:
    """Round a double half to even on its exact binary value, as every stored figure in this library is rounded.

    `bround` works on the shortest decimal text, so it sees a tie where the stored double lies above or below it. Here
    the rounding error of `value * 10^digits` is recovered exactly (split product) and settles such cases.
    """
    x, scale = value.cast("double"), float(10 ** digits)
    product = x * scale
    below = F.floor(product).cast("double")
    part = product - below
    split = x * 134217729.0
    head = split - (split - x)
    error = (head * scale - product) + (x - head) * scale
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (F.abs(below % 2) == 1))))
    return (below + F.when(up, 1.0).otherwise(0.0)) / scale


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double; null when the denominator is null or zero."""
    den = denominator.cast("double")
    return F.when(den != 0, numerator.cast("double") / den)


def money(value: Column) -> Column:
    """Money as DECIMAL, so sums do not depend on the order of partitions."""
    return value.cast(MONEY)


def clip(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
