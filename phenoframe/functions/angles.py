"""Directions in degrees, measured like image coordinates (y grows downwards)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def modulo(value: Column, base) -> Column:
    return F.pmod(value, F.lit(float(base)))


def turn(a: Column, b: Column) -> Column:
    """Smallest absolute difference of two directions, 0..180."""
    return F.abs(modulo(a - b + 180.0, 360) - 180.0)


def heading(dx: Column, dy: Column) -> Column:
    """Direction of a step, 0..360; null for a zero step."""
    return F.when((dx != 0) | (dy != 0), modulo(F.degrees(F.atan2(dy, dx)), 360))


def principal_axis(sxx: Column, syy: Column, sxy: Column) -> Column:
    """Orientation in degrees of the larger axis of a 2x2 covariance matrix."""
    return F.degrees(F.atan2(2.0 * sxy, sxx - syy) / 2.0)
