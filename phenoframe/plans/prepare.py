"""Preparation of whole images: search frame, plate, stems, analysis box, background and edges.

All images go through each step together. Pixels stay rows, so an image that holds most of them is spread like any
other; only the background and edge filters work on tiles of fixed size.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from phenoframe.functions import color, geometry as g
from phenoframe.operators import components, luminance, pixels, regions, stems, tiles
from phenoframe.params import Params
from phenoframe.runtime import cut

CHANNELS = ("b", "g", "r")
KEY = ["image_id"]
SHAPE = ["image_id", "width", "height"]


class Prepared(NamedTuple):
    """Tables of prepared images; all but ``images`` are in pixels of the analysis box."""

    images: DataFrame  # image_id, plate_x, plate_y, plate_width, plate_height, width, height, to_crop, reason
    stems: DataFrame  # image_id, slot, x, y, area
    display: DataFrame  # image_id, x, y, b, g, r as photographed
    erased: DataFrame  # the same without the stems
    process: DataFrame  # grey tiles without background

    def edges(self, size: int = tiles.SIZE) -> DataFrame:
        """(image_id, x, y) of the edges; ``size`` is that of the tiles."""
        return tiles.edge_pixels(self.process, size=size)


def _mask(px: DataFrame, shapes: DataFrame, lower: tuple, upper: tuple) -> DataFrame:
    """Pixels of a colour range, with the size of their image."""
    coloured = px.withColumn("_c", color.hsv(*[F.col(c) for c in CHANNELS]))
    hit = color.in_range(F.col("_c.h"), F.col("_c.s"), F.col("_c.v"), lower, upper)
    return coloured.where(hit).select("image_id", "x", "y").join(shapes.select(*SHAPE), KEY).select(*SHAPE, "x", "y")


def _size() -> tuple[Column, Column]:
    return F.col("width"), F.col("height")


def find_plates(px: DataFrame, shapes: DataFrame, params: Params) -> DataFrame:
    """(image_id, x, y, width, height): bounds of the plate's colour, or the whole image."""
    if not params.crop.background_enabled:
        zero = F.lit(0)
        return shapes.select("image_id", zero.alias("x"), zero.alias("y"), "width", "height")
    blue = _mask(px, shapes, params.crop.blue_hsv_lower, params.crop.blue_hsv_upper)
    blue = pixels.erode(blue, SHAPE, 3, *_size())
    sizes = cut(regions.region_sizes(components.label_pixels(blue, KEY), KEY), "plates")
    return regions.plate_bounds(sizes, shapes, KEY, params.crop.background_region == "all")


def find_stem_regions(px: DataFrame, shapes: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """Regions of the stems' colour that are large enough, and their pixels."""
    green = _mask(px, shapes, params.green.hsv_lower, params.green.hsv_upper)
    green = pixels.erode(pixels.dilate(green, SHAPE, 3, *_size()), SHAPE, 1, *_size())
    labelled = cut(components.label_pixels(green, KEY), "green")
    sizes = cut(regions.region_filter(labelled, KEY, params.green.min_count, params.green.min_area), "regions")
    passed = sizes.where("reason is null")
    return passed, labelled.join(passed.select("image_id", "label"), ["image_id", "label"], "left_semi")


def prepare(px: DataFrame, images: DataFrame, params: Params, radius: int = 50, smooth: int = 2, size: int = tiles.SIZE) -> Prepared:
    """Prepare all ``images`` (image_id, width, height, degrees, search, own) from their pixels (image_id, x, y, b, g, r).

    ``search`` is a box to look for plates in (null: the whole image turned by ``degrees``), ``own`` an analysis box of the
    plate (null: the fixed one of ``params``). Pixels without a row are zero and belong to no colour range.

    Every image keeps a row in ``images``; ``reason`` says why it has no tiles ("no pixels", "box longer than the
    image"), or that its stems are left out ("fewer stems than plants"), in which case its pixels are prepared all the same.
    """
    whole = (F.col("width").cast("double"), F.col("height").cast("double"))
    framed = images.withColumn("_f", g.search_frame(*whole, F.col("degrees"), F.col("search"))).join(
        px.select("image_id").distinct().withColumn("_seen", F.lit(True)), KEY, "left")
    framed = cut(framed.select(
        "image_id", "own", F.col("_f.w").alias("width"), F.col("_f.h").alias("height"), F.col("_f.m").alias("_m"), F.col("_seen").isNotNull().alias("_seen")), "frames")
    usable = framed.where("_seen")
    searched = cut(tiles.extract_pixels(px, usable.select(
        "image_id", F.col("width").alias("out_w"), F.col("height").alias("out_h"), g.affine_inverse(F.col("_m")).alias("to_source")), "image_id", CHANNELS), "searched")

    plates = cut(find_plates(searched, usable.select(*SHAPE), params), "bounds")
    moved = plates.select("image_id", F.col("x").alias("_x"), F.col("y").alias("_y"), "width", "height")
    x, y = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    plate = cut(searched.join(moved, KEY).where(x.between(0, F.col("width") - 1) & y.between(0, F.col("height") - 1)).select(
        "image_id", x.alias("x"), y.alias("y"), *CHANNELS), "plate")
    found, marks = find_stem_regions(plate, plates, params)
    erased = luminance.erase_regions(plate, marks, KEY, CHANNELS)

    margins = F.struct(*[F.lit(float(getattr(params, f"margin_{side}"))).alias(side) for side in ("top", "bottom", "left", "right")])
    box = g.analysis_box(*whole, F.lit(float(params.crop.top_ratio)), F.lit(float(params.crop.bottom_ratio)), margins, F.col("own"))
    boxes = plates.join(framed.select("image_id", "own"), KEY).withColumn("_b", box).withColumn("_e", g.box_extraction(F.col("_b"), *whole))
    boxes = cut(boxes.select(
        "image_id", F.col("x").alias("plate_x"), F.col("y").alias("plate_y"), F.col("width").alias("plate_width"), F.col("height").alias("plate_height"), "_e.*"), "boxes")
    fits = boxes.where("ok").select("image_id", "out_w", "out_h", "to_source")
    display = tiles.extract_pixels(plate, fits, "image_id", CHANNELS)
    cropped = cut(tiles.extract_pixels(erased, fits, "image_id", CHANNELS), "erased")

    placed = cut(stems.cluster_stems(found, KEY, params.n_clusters).join(boxes.where("ok").select("image_id", "to_crop"), KEY), "stems")
    at = [F.bround(f(F.col("to_crop"), F.col("x"), F.col("y"))).cast("int") for f in (g.affine_x, g.affine_y)]
    grey = tiles.remove_gradient(tiles.sized_tiles(cropped, CHANNELS, fits.select(
        "image_id", F.col("out_w").alias("width"), F.col("out_h").alias("height")), size), radius, smooth, size)

    stemmed = placed.select("image_id").distinct().withColumn("_stems", F.lit(True))
    reason = F.when(~F.col("_seen"), "no pixels").when(~F.col("ok"), "box longer than the image").when(F.col("_stems").isNull(), "fewer stems than plants")
    done = framed.select("image_id", "_seen").join(boxes, KEY, "left").join(stemmed, KEY, "left").select(
        "image_id", "plate_x", "plate_y", "plate_width", "plate_height", F.col("out_w").alias("width"), F.col("out_h").alias("height"), "to_crop", reason.alias("reason"))
    return Prepared(
        done, placed.select("image_id", "slot", at[0].alias("x"), at[1].alias("y"), "area"), display, cropped, grey)
