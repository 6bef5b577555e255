"""Rates, decreases and offsets along dated series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from phenoframe.functions import growth as fg
from phenoframe.operators.ordered import ordered_columns


def growth_rates(
    df: DataFrame, subject: Sequence[str], date: str, values: Mapping[str, str],
    *, tie: Sequence[str] = (), on_invalid: str = "null", bounded: bool = False,
) -> DataFrame:
    """Add one relative growth rate per measure; ``values`` maps measure to output name."""
    lags = {"_date": F.col(date)} | {f"_v{i}": F.col(v) for i, v in enumerate(values)}
    rows = ordered_columns(df, subject, [date, *tie], lags=lags, bounded=bounded)
    days = fg.whole_days(F.col("_date"), F.col(date))
    return rows.select(
        *df.columns,
        days.alias("elapsed_days"),
        *[
            fg.relative_rate(F.col(v), F.col(f"_v{i}"), days, on_invalid).alias(name)
            for i, (v, name) in enumerate(values.items())
        ],
    )


def area_changes(
    df: DataFrame, group: Sequence[str], date: str, area: str, new_area: str,
    *, tie: Sequence[str] = (), bounded: bool = False, into: str = "area_change",
) -> DataFrame:
    rows = ordered_columns(df, group, [date, *tie], lags={"_area": F.col(area)}, bounded=bounded)
    return rows.withColumn(into, fg.area_change(F.col(area), F.col(new_area), F.col("_area"))).drop("_area")


def decreases(
    df: DataFrame, subject: Sequence[str], date: str, keys: Sequence[str],
    *, tie: Sequence[str] = (), bounded: bool = False,
) -> DataFrame:
    """One row per measure that fell below the last known value; nulls are skipped.

    All measures are unpivoted and compared in one pass.
    """
    pairs = ", ".join(f"'{k}', cast(`{k}` as double)" for k in keys)
    long = df.select(
        *subject, date, *tie, F.expr(f"stack({len(keys)}, {pairs}) as (measure, value)")
    ).where("value is not null")
    lagged = ordered_columns(
        long, [*subject, "measure"], [date, *tie], lags={"previous": F.col("value")}, bounded=bounded
    )
    return lagged.where(F.col("value") < F.col("previous")).select(
        *subject, date, *tie, "measure", "previous", "value"
    )


def override_sessions(
    df: DataFrame, group: Sequence[str], order: Sequence[str], is_override: Column,
    *, bounded: bool = False, into: str = "session",
) -> DataFrame:
    """Session number that grows at every override frame, which starts its own history."""
    return ordered_columns(
        df, group, order, sums={into: F.when(is_override, 1).otherwise(0)}, bounded=bounded
    )


def cumulative_offsets(
    df: DataFrame, group: Sequence[str], order: Sequence[str], dx: str, dy: str, *, bounded: bool = False
) -> DataFrame:
    """Turn frame-to-frame offsets into offsets from the first frame."""
    return ordered_columns(
        df, group, order,
        sums={"total_dx": F.coalesce(dx, F.lit(0)), "total_dy": F.coalesce(dy, F.lit(0))}, bounded=bounded,
    )


def arc_length(
    df: DataFrame, path: Sequence[str], order: Sequence[str], x: str, y: str, *, bounded: bool = False
) -> DataFrame:
    """Distance travelled along each path up to every point."""
    lagged = ordered_columns(
        df, path, order, lags={"_p": F.struct(F.col(x).alias("x"), F.col(y).alias("y"))}, bounded=bounded
    )
    step = F.coalesce(F.hypot(F.col(x) - F.col("_p.x"), F.col(y) - F.col("_p.y")), F.lit(0.0))
    lagged = lagged.withColumn("_step", step)
    return ordered_columns(lagged, path, order, sums={"arc": F.col("_step")}, bounded=bounded).drop("_p", "_step")
