"""Stem positions from coloured regions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from phenoframe.functions import geometry
from phenoframe.runtime import spread


def _split_points(x: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Cluster number of sorted distinct values, minimising the squared deviation (dynamic programming)."""
    n = len(x)
    w, s, q = (np.concatenate(([0.0], (weight * x**p).cumsum())) for p in (0, 1, 2))
    cost = np.full(n + 1, np.inf)
    cost[0] = 0.0
    choice = np.zeros((k, n + 1), int)
    for c in range(k):
        following = np.full(n + 1, np.inf)
        for end in range(c + 1, n + 1):
            start = np.arange(c, end)
            spread = (q[end] - q[start]) - (s[end] - s[start]) ** 2 / (w[end] - w[start])
            total = cost[start] + spread
            best = int(np.argmin(total))
            following[end], choice[c, end] = total[best], start[best]
        cost = following
    label, end = np.zeros(n, int), n
    for c in range(k - 1, -1, -1):
        start = choice[c, end]
        label[start:end], end = c, start
    return label


def cluster_stems(regions: DataFrame, image: Sequence[str], count: int) -> DataFrame:
    """(image, slot, x, y, area): ``count`` stems per image from left to right.

    ``regions`` has min_x, max_x, min_y, max_y, area. Regions are counted per centre column
    first, so a task receives at most two rows per image column however many regions there are.
    Images with fewer regions than stems give no rows, as partial clusters would shift identities.
    With enough regions but fewer columns than stems, columns stay apart and the fullest ones (the
    left one on a tie) are split from top to bottom.
    """
    image = list(image)
    centred = regions.select(
        *image, ((F.col("min_x") + F.col("max_x") + 1) / 2.0).alias("cx"), ((F.col("min_y") + F.col("max_y") + 1) / 2.0).alias("cy"), "area"
    )
    columns = centred.groupBy(*image, "cx").agg(F.count(F.lit(1)).alias("n"))

    def cluster(group: pa.Table) -> pa.Table:
        group = group.sort_by("cx")
        cx, n = group.column("cx").to_numpy(), group.column("n").to_numpy()
        parts = np.ones(len(cx), int)
        if n.sum() < count:
            group, number, parts = group.slice(0, 0), parts[:0], parts[:0]
        elif len(cx) >= count:
            number = _split_points(cx, n.astype(float), count)
        else:
            for _ in range(count - len(cx)):
                parts[int(np.argmax(np.where(parts < n, n / parts, 0)))] += 1
            number = np.cumsum(parts) - parts
        return group.append_column("cluster", pa.array(number, pa.int32())).append_column("parts", pa.array(parts, pa.int32()))

    kinds = dict(columns.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns.columns) + ", cluster int, parts int"
    found = centred.join(spread(columns, *image).groupBy(*image).applyInArrow(cluster, schema), [*image, "cx"])
    # Columns in several parts exist only in images with fewer columns than stems.
    down = Window.partitionBy(*image, "cx").orderBy("cy", "area")
    split = found.where("parts > 1").withColumn("cluster", F.col("cluster") + F.floor((F.row_number().over(down) - 1) * F.col("parts") / F.col("n")).cast("int"))
    labelled = found.where("parts = 1").unionByName(split).drop("n", "parts")

    def median(column):
        counts = labelled.groupBy(*image, "cluster", column).agg(F.count(F.lit(1)).alias("_n"))
        middle = F.bround(F.percentile(column, F.lit(0.5), F.col("_n"))).cast("int")
        return counts.groupBy(*image, "cluster").agg(middle.alias("x" if column == "cx" else "y"))

    area = labelled.groupBy(*image, "cluster").agg(F.sum("area").cast("long").alias("area"))
    found = median("cx").join(median("cy"), [*image, "cluster"]).join(area, [*image, "cluster"])
    order = Window.partitionBy(*image).orderBy("x", "cluster")  # ``count`` rows per image
    return found.select(*image, (F.row_number().over(order) - 1).alias("slot"), "x", "y", "area")


def outdated_groups(images: DataFrame, state: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, reason): groups whose stored maps can't be used again and that need the whole preparation.

    ``images`` has group, to_crop and to_stored (six numbers each); ``state`` group, prepare_hash (null if never stored) and
    stored_hash. One image without a map is enough, as a group is prepared as a whole.
    """
    maps = images.groupBy(*group).agg(F.max(F.coalesce(F.size("to_stored"), F.lit(-1)) != 6).alias("_lacks"))
    changed = F.col("stored_hash").isNotNull() & ~F.col("stored_hash").eqNullSafe(F.col("prepare_hash"))
    reason = F.when(F.col("_lacks"), "no stored map").when(F.coalesce(changed, F.lit(False)), "settings changed")
    return maps.join(state, list(group), "left").select(*group, reason.alias("reason")).where("reason is not null")


def redetect_stems(
    regions: DataFrame, images: DataFrame, state: DataFrame, group: Sequence[str], image: Sequence[str], count: int,
) -> DataFrame:
    """:func:`cluster_stems` in the coordinates of stored pixels, without preparing the images again.

    ``regions`` are those of plates; positions go through ``to_crop`` of their image, are rounded, and move by the whole
    pixels that the stored map ``to_stored`` lies further. Groups listed by :func:`outdated_groups` give no rows.
    """
    usable = images.join(outdated_groups(images, state, group), list(group), "left_anti").select(*image, "to_crop", "to_stored")
    found = cluster_stems(regions.join(usable.select(*image), list(image), "left_semi"), image, count).join(usable, list(image))

    def stored(place: Column, k: int) -> Column:
        return (F.bround(place) + F.bround(F.col("to_stored")[k] - F.col("to_crop")[k])).cast("int")

    x, y = F.col("x"), F.col("y")
    return found.select(
        *image, "slot", stored(geometry.affine_x(F.col("to_crop"), x, y), 2).alias("x"), stored(geometry.affine_y(F.col("to_crop"), x, y), 5).alias("y"), "area")
