"""Growth between two observations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def whole_days(earlier: Column, later: Column) -> Column:
    """Complete 24-hour periods, not midnights crossed."""
    return F.timestamp_diff("DAY", earlier, later)


def relative_rate(value: Column, previous: Column, days: Column, on_invalid: str = "null") -> Column:
    """(ln value - ln previous) / days.

    ``null`` gives null unless all three are positive. ``inf`` only requires a positive
    previous value, so a vanished root yields -Infinity and same-day frames divide by zero.
    """
    rate = (F.ln(value) - F.ln(previous)) / days
    if on_invalid == "null":
        return F.when((value > 0) & (previous > 0) & (days > 0), rate)
    if on_invalid != "inf":
        raise ValueError("on_invalid must be 'null' or 'inf'")
    change = F.when(value <= 0, F.lit(float("-inf"))).otherwise(F.ln(value) - F.ln(previous))
    same_day = (
        F.when(change > 0, F.lit(float("inf")))
        .when(change < 0, F.lit(float("-inf")))
        .otherwise(F.lit(float("nan")))
    )
    return F.when(previous > 0, F.when(days == 0, same_day).otherwise(F.try_divide(change, days)))


def area_change(area: Column, new_area: Column, previous_area: Column) -> Column:
    """Percentage by which the old part of the area differs from the previous area."""
    return F.when(
        (area > 0) & (previous_area > 0) & new_area.isNotNull(),
        F.abs(area - new_area - previous_area) / previous_area * 100.0,
    )
