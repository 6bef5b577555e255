"""Nearest neighbours between integer pixel tables.

Equal positions are collapsed before any matching, so the number of candidates per position is
bounded by the searched area however many rows share it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from phenoframe.runtime import cut

CELL_BITS = 3


def _cells(df: DataFrame, size: int, spread: bool) -> DataFrame:
    cx, cy = F.floor(F.col("x") / size), F.floor(F.col("y") / size)
    if not spread:
        return df.withColumn("_cx", cx).withColumn("_cy", cy)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return (
        df.withColumn("_o", F.explode(around))
        .withColumn("_cx", cx + F.col("_o.i")).withColumn("_cy", cy + F.col("_o.j")).drop("_o")
    )


def pairs_within(points: DataFrame, targets: DataFrame, radius: float, keys: Sequence[str], payload: Sequence[str] = ()) -> DataFrame:
    """Nearest target within ``radius`` of every distinct point position.

    ``payload`` columns of the targets split the answer: one nearest target per position and
    payload. Returns (keys, x, y, payload, tx, ty, d2); ties go to the smallest (ty, tx).
    """
    size = max(1, int(-(-radius // 1)))
    here = _cells(points.select(*keys, "x", "y").distinct(), size, spread=True)
    there = _cells(targets.select(*keys, *payload, "x", "y").distinct(), size, spread=False).withColumnsRenamed(
        {"x": "tx", "y": "ty"}
    )
    d2 = (F.col("x") - F.col("tx")).cast("long") * (F.col("x") - F.col("tx")) + (
        F.col("y") - F.col("ty")
    ).cast("long") * (F.col("y") - F.col("ty"))
    best = (
        here.join(there, [*keys, "_cx", "_cy"])
        .withColumn("d2", d2)
        .where(F.col("d2") <= float(radius) ** 2)
        .groupBy(*keys, "x", "y", *payload)
        .agg(F.min(F.struct("d2", "ty", "tx")).alias("_b"))
    )
    return best.select(*keys, "x", "y", *payload, F.col("_b.tx").alias("tx"), F.col("_b.ty").alias("ty"), F.col("_b.d2").alias("d2"))


def nearest_within(points: DataFrame, targets: DataFrame, radius: float, keys: Sequence[str], payload: Sequence[str] = ()) -> DataFrame:
    """Every point row with its nearest target within ``radius``, or nulls.

    When several targets share the nearest position, the smallest payload is taken.
    """
    unique = targets.groupBy(*keys, "x", "y").agg(*[F.min(c).alias(c) for c in payload]) if payload else targets
    found = pairs_within(points, unique, radius, keys, payload)
    if payload:
        best = found.groupBy(*keys, "x", "y").agg(F.min(F.struct("d2", "ty", "tx", *payload)).alias("_b"))
        found = best.select(
            *keys, "x", "y", F.col("_b.tx").alias("tx"), F.col("_b.ty").alias("ty"), F.col("_b.d2").alias("d2"),
            *[F.col(f"_b.{c}").alias(c) for c in payload],
        )
    return points.join(found, [*keys, "x", "y"], "left")


def nearest(
    points: DataFrame, targets: DataFrame, keys: Sequence[str], *, above: bool = False, rank: str | None = None, gate: str | None = None,
    manhattan: bool = False,
) -> DataFrame:
    """Exact nearest target at any distance and for any coordinates.

    With ``above`` only targets with ``ty <= y`` count, with ``gate`` only those whose column of that name is at most ``y``;
    positions without one have no row. ``rank`` names a column of the targets whose smallest value decides between equal
    distances and is returned; without it (ty, tx) decides. With ``manhattan`` the distance is the sum of both differences,
    and ``d2`` holds it unsquared.

    Targets form a pyramid of occupied cells, as high as they are spread. Each position starts with the top cell and
    descends level by level, keeping only the cells that can still hold its nearest target: the
    smallest upper bound of a position discards every cell whose lower bound exceeds it. A few
    candidates per position survive each level, whatever the distance.
    Returns (keys, x, y, tx, ty, d2).
    """
    # The pyramid stands on the smallest target coordinates; points may lie anywhere.
    limited = gate or ("y" if above else None)
    base = targets.select(*keys, "x", "y", F.col(limited or "y").alias("_gate"), *([F.col(rank).alias("_rank")] if rank else []))
    if rank:
        base = cut(base.groupBy(*keys, "x", "y", "_gate").agg(F.min("_rank").alias("_rank")), "targets")
    else:
        base = cut(base.distinct(), "targets")
    x0, y0, x1, y1 = base.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    x0, y0, x1, y1 = (0, 0, 0, 0) if x0 is None else (x0, y0, x1, y1)
    kinds = dict(base.dtypes)
    base = base.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0, "_gate": F.col("_gate") - y0})
    points = points.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})
    levels = 1
    while (1 << (CELL_BITS * levels)) <= max(x1 - x0, y1 - y0):
        levels += 1

    def corner(size: int) -> tuple[Column, Column]:
        return F.floor(F.col("x") / size) * size, F.floor(F.col("y") / size) * size

    found = points.select(*keys, "x", "y").distinct().select(*keys, "x", "y", F.lit(0).alias("_px"), F.lit(0).alias("_py"))
    for level in range(levels - 1, -1, -1):
        size, parent = 1 << (CELL_BITS * level), 1 << (CELL_BITS * (level + 1))
        cx, cy = corner(size)
        px, py = corner(parent)
        cells = base.groupBy(*keys, cx.alias("_cx"), cy.alias("_cy"), px.alias("_px"), py.alias("_py")).agg(F.min("_gate").alias("_top"))
        # At most 64 children per parent cell.
        children = cells.groupBy(*keys, "_px", "_py").agg(
            F.collect_list(F.struct("_cx", "_cy", "_top")).alias("_children")
        )

        def bound(c: Column, p: str, far: bool) -> Column:
            lo, hi = c - F.col(p), F.col(p) - (c + size - 1)
            if far:
                return F.greatest(F.abs(lo), F.abs(hi))
            return F.greatest(lo, hi, F.lit(0))

        def squared(child: Column, far: bool) -> Column:
            dx, dy = bound(child["_cx"], "x", far), bound(child["_cy"], "y", far)
            return dx + dy if manhattan else dx * dx + dy * dy

        # A cell whose smallest gate lies deeper holds no target; any other keeps one within its upper bound.
        usable = F.filter("_children", lambda c: c["_top"] <= F.col("y")) if limited else F.col("_children")
        joined = found.join(children, [*keys, "_px", "_py"]).select(
            *keys, "x", "y",
            F.transform(
                usable,
                lambda c: F.struct(squared(c, False).alias("near"), squared(c, True).alias("far"), c["_cx"].alias("cx"), c["_cy"].alias("cy")),
            ).alias("_c"),
        )
        # Prune inside the row first, then across the rows of one position.
        own = F.array_min(F.transform("_c", lambda c: c["far"]))
        joined = joined.withColumn("_far", own).withColumn("_c", F.filter("_c", lambda c: c["near"] <= F.col("_far")))
        merged = joined.groupBy(*keys, "x", "y").agg(
            F.min("_far").alias("_far"), F.flatten(F.collect_list("_c")).alias("_c")
        )
        found = merged.select(
            *keys, "x", "y", F.explode(F.filter("_c", lambda c: c["near"] <= F.col("_far"))).alias("_k")
        ).select(*keys, "x", "y", F.col("_k.cx").alias("_px"), F.col("_k.cy").alias("_py"))
    dx, dy = F.col("x") - F.col("_px"), F.col("y") - F.col("_py")
    d2 = F.abs(dx) + F.abs(dy) if manhattan else dx * dx + dy * dy
    if rank:
        found = found.join(base.select(*keys, F.col("x").alias("_px"), F.col("y").alias("_py"), "_gate", "_rank"), [*keys, "_px", "_py"])
        found = found.where("_gate <= y") if limited else found
    order = ["_rank"] if rank else []
    best = found.groupBy(*keys, "x", "y").agg(F.min(F.struct(d2.alias("d2"), *order, F.col("_py"), F.col("_px"))).alias("_b"))
    place = {"x": F.col("x") + x0, "y": F.col("y") + y0, "tx": F.col("_b._px") + x0, "ty": F.col("_b._py") + y0}
    return best.select(*keys, *[v.cast(kinds[k[-1]]).alias(k) for k, v in place.items()], F.col("_b.d2").alias("d2"), *[F.col("_b._rank").alias(rank) for _ in order])


def minimum_gap(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest distance between two pixel sets per key."""
    return nearest(first, second, keys).groupBy(*keys).agg(F.sqrt(F.min("d2")).alias("gap"))
