"""Offsets between consecutive edge images."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

CELLS = 1024


def _factor(extent: int, cells: int) -> int:
    factor = 1
    while extent / factor > cells:
        factor *= 2
    return factor


def pair_offsets(
    edges: DataFrame, group: Sequence[str], frame: str, width: int, height: int, margin: float = 0.25,
    cells: int = CELLS,
) -> DataFrame:
    """(group, frame, dx, dy): shift that lays each frame's edges on the preceding frame's.

    The score of a shift is ``overlap - density * edges in the window``, and shifts up to
    ``margin`` of the image size are tried. The best shift is found on a reduced image of at most
    ``cells`` cells a side, one bounded grid per frame pair, and then refined by halving the cell size:
    each step is an equi-join of cells on 25 shifted positions. ``cells`` bounds a task's memory; images
    no larger than it are scored exactly at once.
    """
    factor = _factor(max(width, height), cells)
    keys = [*group, frame]
    reduced = _reduce(edges, keys, factor)
    # Only frames with edges on both sides form a pair.
    both = (
        reduced.select(*keys).distinct()
        .join(reduced.select(*group, (F.col(frame) + 1).alias(frame)).distinct(), keys)
    )
    sides = (
        reduced.withColumn("_side", F.lit(1))
        .unionByName(reduced.withColumn(frame, F.col(frame) + 1).withColumn("_side", F.lit(0)))
        .join(both, keys, "left_semi")
    )
    w, h = -(-width // factor), -(-height // factor)
    mx, my = int(width * margin) // factor, int(height * margin) // factor
    fields = [f for f in edges.select(*keys).schema.fields]
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        image = [np.zeros((h, w)) for _ in range(2)]
        for side in (0, 1):
            part = pdf[pdf["_side"] == side]
            image[side][part["y"].to_numpy(), part["x"].to_numpy()] = part["n"].to_numpy()
        template, target = image
        shape = (h + 2 * my + h, w + 2 * mx + w)
        padded = np.zeros((h + 2 * my, w + 2 * mx))
        padded[my:my + h, mx:mx + w] = target
        spectrum = np.fft.rfft2(padded, shape) * np.conj(np.fft.rfft2(template, shape))
        overlap = np.rint(np.fft.irfft2(spectrum, shape)[: 2 * my + 1, : 2 * mx + 1])
        total = np.zeros((padded.shape[0] + 1, padded.shape[1] + 1))
        total[1:, 1:] = padded.cumsum(0).cumsum(1)
        window = total[h:, w:] - total[:-h, w:] - total[h:, :-w] + total[:-h, :-w]
        score = overlap * (w * h) - template.sum() * window
        top, left = np.unravel_index(int(np.argmax(score)), score.shape)
        row = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**row, "dx": [mx - left], "dy": [my - top]})

    found = sides.groupBy(*keys).applyInPandas(best, f"{names}, dx int, dy int")
    while factor > 1:
        factor //= 2
        found = _refine(edges, found, list(group), frame, factor, width, height, margin)
    return found


def _reduce(edges: DataFrame, keys, factor: int) -> DataFrame:
    return edges.groupBy(
        *keys, F.floor(F.col("x") / factor).cast("int").alias("x"), F.floor(F.col("y") / factor).cast("int").alias("y")
    ).agg(F.count_distinct("x", "y").alias("n"))


def _refine(edges, found, group, frame, factor, width, height, margin) -> DataFrame:
    keys = [*group, frame]
    cells = _reduce(edges, keys, factor)
    w, h = -(-width // factor), -(-height // factor)
    mx, my = int(width * margin) // factor, int(height * margin) // factor
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])
    tries = (
        found.withColumn("_o", F.explode(around))
        .select(*keys, (F.col("dx") * 2 + F.col("_o.i")).alias("dx"), (F.col("dy") * 2 + F.col("_o.j")).alias("dy"))
        .where((F.abs("dx") <= mx) & (F.abs("dy") <= my))
    )
    template = cells.select(*group, (F.col(frame) + 1).alias(frame), "x", "y", F.col("n").alias("_t"))
    density = template.groupBy(*keys).agg((F.sum("_t") / F.lit(float(w * h))).alias("_density"))
    moved = cells.join(tries, keys).select(*keys, "dx", "dy", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "n")
    inside = moved.where(F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1))
    scored = inside.join(template, [*keys, "x", "y"], "left").groupBy(*keys, "dx", "dy").agg(
        F.sum(F.coalesce("_t", F.lit(0)) * F.col("n")).alias("_overlap"), F.sum("n").alias("_window")
    ).join(density, keys)
    score = F.col("_overlap") - F.col("_density") * F.col("_window")
    return scored.groupBy(*keys).agg(F.max_by(F.struct("dx", "dy"), F.struct(score, F.col("dy"), F.col("dx"))).alias("_b")).select(
        *keys, F.col("_b.dx").alias("dx"), F.col("_b.dy").alias("dy")
    )


def shift(df: DataFrame, offsets: DataFrame, on: Sequence[str], width: Column, height: Column, dx: str = "dx", dy: str = "dy") -> DataFrame:
    """Move pixels by their frame's offset and crop to the first frame's box."""
    named = offsets.select(*on, F.col(dx).alias("_dx"), F.col(dy).alias("_dy"))
    joined = df.join(named, list(on), "left").withColumn("x", F.col("x") + F.coalesce("_dx", F.lit(0))).withColumn(
        "y", F.col("y") + F.coalesce("_dy", F.lit(0))
    )
    return joined.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)).select(*df.columns)
