"""8-bit colour arithmetic: hue 0..179, saturation and value 0..255."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def gray(b: Column, g: Column, r: Column) -> Column:
    return F.round(0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def hsv(b: Column, g: Column, r: Column) -> Column:
    """struct<h,s,v> of one BGR pixel."""
    top = F.greatest(b, g, r)
    span = top - F.least(b, g, r)
    sector = (
        F.when(span == 0, F.lit(0.0))
        .when(top == r, 60.0 * (g - b) / span)
        .when(top == g, 120.0 + 60.0 * (b - r) / span)
        .otherwise(240.0 + 60.0 * (r - g) / span)
    )
    hue = F.pmod(F.round(F.pmod(sector, F.lit(360.0)) / 2.0), F.lit(180.0))
    saturation = F.when(top == 0, F.lit(0.0)).otherwise(F.round(255.0 * span / top))
    return F.struct(
        hue.cast("int").alias("h"), saturation.cast("int").alias("s"), top.cast("int").alias("v")
    )


def in_range(h: Column, s: Column, v: Column, lower, upper) -> Column:
    """Range test; a lower hue above the upper hue means a range through 179/0."""
    rest = s.between(lower[1], upper[1]) & v.between(lower[2], upper[2])
    if lower[0] <= upper[0]:
        return h.between(lower[0], upper[0]) & rest
    return ((h >= lower[0]) | (h <= upper[0])) & rest


def circular_mean_hue(h: Column) -> Column:
    """Aggregate: mean hue on the circle of 180 steps."""
    angle = h * (math.pi / 90.0)
    mean = F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))) * (90.0 / math.pi)
    # Noise in the last digits must not decide a tie.
    return F.pmod(F.bround(F.round(mean, 9)), F.lit(180.0)).cast("int")


def range_of_two(first: Column, second: Column) -> Column:
    """struct<lower,upper> bounded by two sampled colours, using the shorter hue arc."""
    low, high = F.least(first["h"], second["h"]), F.greatest(first["h"], second["h"])
    wraps = high - low > 90
    lower = F.struct(
        F.when(wraps, high).otherwise(low).alias("h"),
        F.least(first["s"], second["s"]).alias("s"),
        F.least(first["v"], second["v"]).alias("v"),
    )
    upper = F.struct(
        F.when(wraps, low).otherwise(high).alias("h"),
        F.greatest(first["s"], second["s"]).alias("s"),
        F.greatest(first["v"], second["v"]).alias("v"),
    )
    return F.struct(lower.alias("lower"), upper.alias("upper"))


def window_around(colour: Column, h_tol: int = 12, s_tol: int = 70, v_tol: int = 70) -> Column:
    """struct<lower,upper> of a tolerance box round one colour, clamped to the valid ranges."""
    def low(name, tol):
        return F.greatest(F.lit(0), colour[name] - tol).alias(name)

    def high(name, tol, top):
        return F.least(F.lit(top), colour[name] + tol).alias(name)

    return F.struct(
        F.struct(low("h", h_tol), low("s", s_tol), low("v", v_tol)).alias("lower"),
        F.struct(high("h", h_tol, 179), high("s", s_tol, 255), high("v", v_tol, 255)).alias("upper"),
    )
