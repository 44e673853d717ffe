"""Rounding and averaging that do not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signless_zero(c: Column) -> Column:
    """Turn -0.0 into 0.0 (their sum is 0.0) so equal numbers also hash alike."""
    return c + F.lit(0.0)


def round_scaled(c: Column, digits: int) -> Column:
    """Round half away from zero on the scaled binary value.

    ``F.round(c, 2)`` rounds the decimal text of the double, which differs from
    binary engines on values such as 1.005. Scaling first gives the same answer
    everywhere.
    """
    scale = F.lit(float(10**digits))
    return signless_zero(F.round(c * scale, 0) / scale)


def half_even(c: Column, digits: int) -> Column:
    """Round half to even (numpy's rule)."""
    scale = F.lit(float(10**digits))
    return signless_zero(F.rint(c * scale) / scale)


def ticks(c: Column, per_unit: int) -> Column:
    """The value as a whole number of ``1/per_unit`` steps."""
    return F.round(c * F.lit(float(per_unit)), 0).cast("bigint")


def mean_of_ticks(c: Column, per_unit: int) -> Column:
    """Mean of values that are multiples of ``1/per_unit``.

    Adding whole ticks is exact, so the mean is the same whatever order the
    shuffle delivers rows in and rounding it later cannot flip at a tie.
    """
    total = F.sum(ticks(c, per_unit)).cast("double")
    return F.try_divide(total / F.lit(float(per_unit)), F.count(c).cast("double"))


def sum_of_ticks(c: Column, per_unit: int) -> Column:
    return F.sum(ticks(c, per_unit)).cast("double") / F.lit(float(per_unit))


def stddev_of_ticks(c: Column, per_unit: int) -> Column:
    """Sample standard deviation of multiples of ``1/per_unit``, from exact sums."""
    step = ticks(c, per_unit).cast("decimal(18,0)")
    n = F.count(c).cast("decimal(10,0)")
    total, squares = F.sum(step).cast("decimal(28,0)"), F.sum((step * step).cast("decimal(28,0)")).cast("decimal(28,0)")
    spread = (n * squares - (total * total).cast("decimal(38,0)")).cast("double")
    pairs = (n * (n - 1)).cast("double")
    return F.sqrt(F.try_divide(spread, pairs)) / F.lit(float(per_unit))
