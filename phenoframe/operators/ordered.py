"""Previous-row, previous-known, running-sum and row-number columns per group.

One group may hold a large share of all rows, and a plain window would sort that group in a
single task. Rows are therefore range-partitioned by (group, order), every partition works on
its own stretch, and a per-stretch summary (at most one row per partition boundary) carries
values across the seams. Callers whose key bounds a group say so and get a plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from phenoframe.runtime import cut

def ordered_columns(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    *,
    lags: Mapping[str, Column] | None = None,
    known: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
    number: str | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Add ordered columns; ``order`` must be total inside a group.

    lags    value of the previous row
    known   last non-null value before this row
    sums    running sum up to and including this row
    number  name of a 1-based row number
    bounded the caller's key bounds a group's rows (one row per day, frame or slot): a plain
            window
    """
    lags, known, sums = dict(lags or {}), dict(known or {}), dict(sums or {})
    group, order = list(group), list(order)
    if bounded:
        return _plain(df, Window.partitionBy(*group).orderBy(*order), lags, known, sums, number)
    return _stretched(df, group, order, lags, known, sums, number)


def _plain(df, window, lags, known, sums, number):
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {name: F.lag(value).over(window) for name, value in lags.items()}
    added |= {name: F.last(value, ignorenulls=True).over(before) for name, value in known.items()}
    added |= {name: F.sum(value).over(upto) for name, value in sums.items()}
    if number:
        added[number] = F.row_number().over(window).cast("long")
    return df.select("*", *[value.alias(name) for name, value in added.items()])


def _stretched(df, group, order, lags, known, sums, number):
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inputs = {f"_l{i}": v for i, v in enumerate(lags.values())}
    inputs |= {f"_k{i}": v for i, v in enumerate(known.values())}
    inputs |= {f"_s{i}": v for i, v in enumerate(sums.values())}
    placed = (
        df.select("*", *[v.alias(k) for k, v in inputs.items()])
        .repartitionByRange(parts, *group, *order)
        .withColumn("_part", F.spark_partition_id())
    )
    # The partition number must not change when a lost task is run again.
    placed = cut(placed, "stretch")

    key = F.struct(*order)
    summary = placed.groupBy(*group, "_part").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.max_by(F.struct(F.col(c)), key).alias(c) for c in inputs if c[1] == "l"],
        *[
            F.max_by(F.when(F.col(c).isNotNull(), F.struct(F.col(c))), F.when(F.col(c).isNotNull(), key)).alias(c)
            for c in inputs if c[1] == "k"
        ],
        *[F.sum(c).alias(c) for c in inputs if c[1] == "s"],
    )
    seam = Window.partitionBy(*group).orderBy("_part")
    earlier = seam.rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *group, "_part",
        F.row_number().over(seam).alias("_stretch"),
        F.sum("_rows").over(earlier).alias("_c_rows"),
        *[F.lag(c).over(seam).alias("_c" + c) for c in inputs if c[1] == "l"],
        *[F.last(c, ignorenulls=True).over(earlier).alias("_c" + c) for c in inputs if c[1] == "k"],
        *[F.sum(c).over(earlier).alias("_c" + c) for c in inputs if c[1] == "s"],
    ).where("_stretch > 1").drop("_stretch")
    # At most one group spans each partition boundary, so carry has fewer rows than partitions.
    rows = placed.join(F.broadcast(carry), [*group, "_part"], "left")

    window = Window.partitionBy(*group, "_part").orderBy(*order)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {}
    for i, name in enumerate(lags):
        own = F.lag(F.struct(f"_l{i}")).over(window)
        added[name] = F.coalesce(own, F.col(f"_c_l{i}"))[f"_l{i}"]
    for i, name in enumerate(known):
        own = F.last(F.when(F.col(f"_k{i}").isNotNull(), F.struct(f"_k{i}")), ignorenulls=True).over(before)
        added[name] = F.coalesce(own, F.col(f"_c_k{i}"))[f"_k{i}"]
    for i, name in enumerate(sums):
        own = F.sum(f"_s{i}").over(upto)
        carried = F.col(f"_c_s{i}")
        added[name] = F.when(own.isNull(), carried).otherwise(own + F.coalesce(carried, F.lit(0)))
    if number:
        added[number] = (F.row_number().over(window) + F.coalesce("_c_rows", F.lit(0))).cast("long")
    return rows.select(*df.columns, *[value.alias(name) for name, value in added.items()])


def runs(df, group, order, flag: Column, *, bounded=False, into="run"):
    """Number the stretches of equal ``flag`` inside each group, starting at 1."""
    marked = df.withColumn("_flag", flag)
    lagged = ordered_columns(
        marked, group, order, lags={"_prev": F.struct("_flag")}, bounded=bounded
    )
    change = F.when(F.col("_prev").isNull() | ~F.col("_prev._flag").eqNullSafe(F.col("_flag")), 1).otherwise(0)
    lagged = lagged.withColumn("_change", change)
    return ordered_columns(
        lagged, group, order, sums={into: F.col("_change")}, bounded=bounded
    ).drop("_flag", "_prev", "_change")
