"""Tone and colour statistics per image.

8-bit levels are counted first, so at most 256 rows per image reach the exact percentile
whatever the image size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from phenoframe.functions import color, tone
from phenoframe.operators import series


def histogram(px: DataFrame, image: Sequence[str], level: str) -> DataFrame:
    return px.groupBy(*image, level).agg(F.count(F.lit(1)).alias("_n"))


def tone_stats(px: DataFrame, image: Sequence[str], level: str) -> DataFrame:
    """Shadow, midtone and highlight (10/50/90 percent) and mean luminance."""
    p = F.percentile(level, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), F.col("_n"))
    return histogram(px, image, level).groupBy(*image).agg(
        p.alias("_p"), (F.sum(F.col(level).cast("long") * F.col("_n")) / F.sum("_n")).alias("mean_luma")
    ).select(
        *image, F.col("_p")[0].alias("shadow"), F.col("_p")[1].alias("mid"), F.col("_p")[2].alias("highlight"), "mean_luma"
    )


def reference_tone(stats: DataFrame, count: int, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Mean tones of up to ``count`` evenly spaced images, one row per group."""
    chosen = series.even_sample(stats, count, order, group)
    means = [F.avg(c).alias(c) for c in ("shadow", "mid", "highlight", "mean_luma")]
    return chosen.groupBy(*group).agg(*means) if group else chosen.agg(*means)


def match_tone(stats: DataFrame, target: DataFrame, on: Sequence[str]) -> DataFrame:
    """Controls that move every image to the target tones; ``target`` has one row per ``on``."""
    names = ("shadow", "mid", "highlight", "mean_luma")
    goal = target.select(*on, *[F.col(c).alias(f"_t_{c}") for c in names])
    joined = stats.join(goal, list(on))
    fits = tone.match({c: F.col(c) for c in names[:3]}, {c: F.col(f"_t_{c}") for c in names[:3]})
    return joined.select(
        *stats.columns, *[v.alias(k) for k, v in fits.items()],
        tone.brightness_match(F.col("mean_luma"), F.col("_t_mean_luma")).alias("brightness_only"),
    )


def hue_gate_range(px: DataFrame, image: Sequence[str], low: int, high: int, *, min_s: int = 40, min_v: int = 40, min_pixels: int = 50) -> DataFrame:
    """Colour range (5th to 95th percentile per channel) of the pixels inside a hue gate.

    ``px`` has h, s, v. Images with fewer than ``min_pixels`` gated pixels give no row.
    """
    gated = px.where(F.col("h").between(low, high) & (F.col("s") >= min_s) & (F.col("v") >= min_v))
    counts = gated.select(
        *image, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("level")) for c in ("h", "s", "v")])).alias("_k")
    ).groupBy(*image, "_k.c", "_k.level").agg(F.count(F.lit(1)).alias("_n"))
    bounds = counts.groupBy(*image, "c").agg(
        F.percentile("level", F.array(F.lit(0.05), F.lit(0.95)), F.col("_n")).alias("_p"), F.sum("_n").alias("_total")
    ).where(F.col("_total") >= min_pixels)
    picked = []
    for c, top in (("h", 179), ("s", 255), ("v", 255)):
        here = F.col("c") == c
        picked.append(F.max(F.when(here, F.floor(F.greatest(F.lit(0.0), F.col("_p")[0])))).cast("int").alias(f"{c}_low"))
        picked.append(F.max(F.when(here, F.floor(F.least(F.lit(float(top)), F.col("_p")[1])))).cast("int").alias(f"{c}_high"))
    return bounds.groupBy(*image).agg(*picked)


def sample_colour(px: DataFrame, picks: DataFrame, image: Sequence[str]) -> DataFrame:
    """Colour of a 3x3 patch round each pick: circular mean hue, median saturation and value.

    ``picks`` has (image, pick, x, y); positions outside the image have no pixel row.
    """
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    wanted = picks.withColumn("_o", F.explode(around)).select(
        *image, "pick", (F.col("x") + F.col("_o.i")).alias("x"), (F.col("y") + F.col("_o.j")).alias("y")
    )
    return px.join(wanted, [*image, "x", "y"]).groupBy(*image, "pick").agg(
        color.circular_mean_hue(F.col("h")).alias("h"),
        F.floor(F.percentile("s", F.lit(0.5))).cast("int").alias("s"),
        F.floor(F.percentile("v", F.lit(0.5))).cast("int").alias("v"),
    )


def erase_regions(px: DataFrame, regions: DataFrame, image: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Set the channels of all region pixels to zero."""
    marks = regions.select(*image, "x", "y", F.lit(True).alias("_hit")).distinct()
    joined = px.join(marks.hint("merge"), [*image, "x", "y"], "left")
    return joined.select(
        *[F.when(F.col("_hit"), F.lit(0)).otherwise(F.col(c)).alias(c) if c in channels else F.col(c) for c in px.columns]
    )


def levels(px: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Two-level binarisation."""
    return px.select("*", (F.col(value) > low).alias("is_low"), (F.col(value) > high).alias("is_high"))


def largest(df: DataFrame, keys: Sequence[str], size: Column, payload: Sequence[str]) -> DataFrame:
    """Top row per key by size; ties go to the smallest payload."""
    best = df.groupBy(*keys).agg(F.max(size).alias("_top"))
    tied = df.withColumn("_size", size).join(best, list(keys)).where("_size = _top")
    return tied.groupBy(*keys).agg(F.min(F.struct(*payload)).alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in payload])
