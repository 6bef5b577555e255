"""Connected components of sparse pixels and of general edge tables.

Pixels are first packed into horizontal runs, which cuts the graph to its row-to-row contacts.
Components are then found by contraction: every vertex points to its lowest neighbour in a
hashed order that changes every round, follows that neighbour's own pointer once, and the graph
is rebuilt between the vertices still pointed at. Under a hashed order chains are short whatever
the shape, so about two thirds of the open vertices are expected to vanish per round. Only
aggregates and equi-joins are used, and every round is written out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from phenoframe.runtime import cut

BLOCK = 64


def pixel_code(x, y) -> Column:
    """One bigint ordered by (y, x)."""
    return F.shiftleft(F.col(y).cast("long") if isinstance(y, str) else y.cast("long"), 32) + (
        (F.col(x) if isinstance(x, str) else x).cast("long")
    )


def code_x(code: Column) -> Column:
    return code.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def code_y(code: Column) -> Column:
    return F.shiftright(code, 32).cast("int")


def connect(edges: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """(keys, id, label) for every vertex that has an edge; the label is the smallest id reached.

    ``keys`` separate independent graphs.
    """
    keys = list(keys)
    both = edges.select(*keys, F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    work = cut(both.unionByName(both.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    steps: list[DataFrame] = []
    while not work.isEmpty():
        def rank(c):
            return F.struct(F.xxhash64(F.lit(len(steps)), F.col(c)).alias("h"), F.col(c).alias("v"))

        least = work.groupBy(*keys, "a").agg(F.min(rank("b")).alias("_m"))
        parent = least.select(*keys, "a", F.least(F.col("_m"), rank("a"))["v"].alias("p"))
        up = parent.select(*keys, F.col("a").alias("p"), F.col("p").alias("q"))
        # Two hops at once: a lower neighbour's own choice is lower still.
        step = cut(
            parent.join(up, [*keys, "p"]).select(*keys, F.col("a").alias("id"), F.col("q").alias("to")), "hook"
        )
        steps.append(step)
        ends = step.select(*keys, F.col("id").alias("a"), F.col("to").alias("ta"))
        moved = work.join(ends, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("ta").alias("b"))
        moved = moved.join(ends, [*keys, "a"]).select(*keys, F.col("ta").alias("a"), "b")
        # A vertex that is pointed at but points on itself stays linked to where it points.
        onward = (
            step.select(*keys, F.col("to").alias("a")).distinct()
            .join(ends, [*keys, "a"]).select(*keys, "a", F.col("ta").alias("b"))
        )
        back = onward.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))
        work = cut(moved.unionByName(onward).unionByName(back).where("a <> b").distinct(), "edges")
    if not steps:
        return both.select(*keys, F.col("a").alias("id"), F.col("a").alias("label"))
    final = steps[-1]
    for step in reversed(steps[:-1]):
        end = final.select(*keys, F.col("id").alias("to"), F.col("to").alias("_end"))
        final = step.join(end, [*keys, "to"], "left").select(*keys, "id", F.coalesce("_end", "to").alias("to"))
    final = cut(final, "reps")
    smallest = final.groupBy(*keys, "to").agg(F.min("id").alias("label"))
    return final.join(smallest, [*keys, "to"]).select(*keys, "id", "label")


def pixel_runs(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Horizontal runs (keys, y, x0, x1) of a pixel set. A row is at most one image width long."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    gap = F.when(F.col("x") - F.lag("x").over(row) == 1, 0).otherwise(1)
    return (
        px.select(*keys, "x", "y").distinct()
        .withColumn("_start", gap)
        .withColumn("_run", F.sum("_start").over(row))
        .groupBy(*keys, "y", "_run")
        .agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
        .drop("_run")
    )


def _contacts(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of touching runs on neighbouring rows, matched inside blocks of 64 columns."""
    lower = runs.select(
        *keys, F.col("y"), "x0", "x1",
        F.explode(F.sequence(F.floor(F.col("x0") / BLOCK), F.floor(F.col("x1") / BLOCK))).alias("_block"),
    )
    upper = runs.select(
        *keys, (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"),
        F.explode(
            F.sequence(F.floor((F.col("x0") - 1) / BLOCK), F.floor((F.col("x1") + 1) / BLOCK))
        ).alias("_block"),
    )
    touching = (F.col("u0") - 1 <= F.col("x1")) & (F.col("x0") <= F.col("u1") + 1)
    return lower.join(upper, [*keys, "y", "_block"]).where(touching).select(
        *keys, pixel_code(F.col("x0"), F.col("y")).alias("a"), pixel_code(F.col("u0"), F.col("y") - 1).alias("b")
    ).distinct()


def label_runs(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs with the label of their component: the (y, x) code of its first pixel."""
    runs = cut(pixel_runs(px, keys), "runs")
    coded = runs.withColumn("id", pixel_code("x0", "y"))
    labels = connect(_contacts(runs, keys), keys)
    return coded.join(labels, [*keys, "id"], "left").select(
        *keys, "y", "x0", "x1", F.coalesce("label", "id").alias("label")
    )


def label_pixels(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, x, y, label) for 8-connected components, x and y coordinates not negative."""
    return label_runs(px, keys).select(*keys, F.explode(F.sequence("x0", "x1")).alias("x"), "y", "label")


def component_stats(labelled: DataFrame, keys: Sequence[str], *extra: Column) -> DataFrame:
    """Area, bounds, box diagonal and elongation test of labelled pixels."""
    stats = labelled.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("area"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x"),
        F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        *extra,
    )
    return stats.withColumn(
        "extent", F.hypot(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    ).withColumn("elongated", F.col("extent") > 2.0 * F.sqrt(4.0 * F.col("area") / F.pi()))


def two_level(px: DataFrame, keys: Sequence[str], value: str, low: float, high: float, *, share: float = 0.2, min_pixels: int = 8) -> DataFrame:
    """Keep a low-level component when more than ``share`` of it passes the high level."""
    candidates = px.where(F.col(value) > low)
    labelled = label_pixels(candidates, keys).join(candidates.select(*keys, "x", "y", value), [*keys, "x", "y"])
    kept = labelled.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("_n"), F.avg((F.col(value) > high).cast("int")).alias("_share")
    ).where((F.col("_n") > min_pixels) & (F.col("_share") > share))
    return labelled.join(kept, [*keys, "label"], "left_semi").select(*keys, "x", "y", "label")


def drop_small(labelled: DataFrame, keys: Sequence[str], min_pixels: int, rescued: DataFrame | None = None) -> DataFrame:
    """Drop small components except those listed as rescued by (keys, label)."""
    large = labelled.groupBy(*keys, "label").count().where(F.col("count") > min_pixels).select(*keys, "label")
    if rescued is not None:
        large = large.unionByName(rescued.select(*keys, "label")).distinct()
    return labelled.join(large, [*keys, "label"], "left_semi")


def rescued_by_history(near: DataFrame, labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Components mostly close to what one owner held before.

    ``near`` has (keys, label, owner, x, y, tx, ty): the nearest earlier pixel of an owner within
    reach of a component pixel. Needs at least ten pixels and half the component, and five
    different earlier pixels.
    """
    sizes = labelled.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n"))
    votes = near.groupBy(*keys, "label", "owner").agg(
        F.count(F.lit(1)).alias("_hits"), F.count_distinct("tx", "ty").alias("_prior")
    )
    return votes.join(sizes, [*keys, "label"]).where(
        (F.col("_hits") >= F.greatest(F.lit(10.0), 0.5 * F.col("_n"))) & (F.col("_prior") >= 5)
    ).select(*keys, "label").distinct()


def new_growth(gain: DataFrame, keys: Sequence[str], value: str, low: float, *, min_pixels: int) -> DataFrame:
    """Area above the low level and the number of large new parts per image."""
    grown = gain.where(F.col(value) > low)
    sizes = label_runs(grown, keys).groupBy(*keys, "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("_n"))
    return sizes.groupBy(*keys).agg(
        F.sum("_n").alias("new_area"), F.count_if(F.col("_n") > min_pixels).alias("new_parts")
    )
