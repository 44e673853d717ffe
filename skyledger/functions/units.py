"""Unit conversion and derived measures for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c_to_f(c: Column) -> Column:
    return c * 9.0 / 5.0 + 32.0


def f_to_c(f: Column | float) -> Column | float:
    return (f - 32.0) * 5.0 / 9.0


def delta_c_to_f(delta: Column) -> Column:
    """A temperature *difference*: scaled, without the 32 degree offset."""
    return delta * 9.0 / 5.0


def _check_unit(unit: str) -> None:
    if unit not in ("C", "F"):
        raise ValueError(f"unit must be 'C' or 'F', not {unit!r}")


def display_temperature(c: Column, unit: str) -> Column:
    _check_unit(unit)
    return c_to_f(c) if unit == "F" else c


def display_delta(c: Column, unit: str) -> Column:
    _check_unit(unit)
    return delta_c_to_f(c) if unit == "F" else c


def rainfall(precip: Column, snow: Column) -> Column:
    """Precipitation that did not fall as snow, never below zero."""
    zero = F.lit(0.0)
    return F.greatest(F.coalesce(precip, zero) - F.coalesce(snow, zero), zero)
