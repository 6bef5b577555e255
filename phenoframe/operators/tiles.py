"""Dense image work on tile rows.

An image is a set of tiles, each a binary block. A filter with radius r sends every tile's
border strips to its neighbours, so one shuffle gives each task a tile with its surroundings;
seams are exact. Groups are one tile plus its strips and therefore of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from phenoframe.runtime import cut, spread
from phenoframe.schema import TILES

SIZE = 512
NAMES = [f.name for f in TILES.fields]
_KINDS = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
_TILE = pa.schema([(f.name, _KINDS[f.dataType.simpleString()]) for f in TILES.fields])
_PIECE = "image_id string, ty int, tx int, py int, px int, h int, w int, channels int, width int, height int, data binary"


def read_tiles(spark: SparkSession, path: str, size: int = SIZE) -> DataFrame:
    """Tiles of all decodable images below ``path``; channels in blue, green, red order.

    Files that do not decode have no tiles; ``undecodable`` lists them.
    """
    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return cut_tiles(images.select(F.col("origin").alias("image_id"), "width", "height", F.col("nChannels").alias("channels"), "data"), size)


def undecodable(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, reason) of the files below ``path`` that cannot be read as images."""
    images = spark.read.format("image").load(path).select("image.origin", "image.nChannels")
    return images.where("nChannels < 0").select(F.col("origin").alias("image_id"), F.lit("not an image").alias("reason"))


def outside(px: DataFrame, width: int, height: int) -> DataFrame:
    """Pixel rows that ``pixels_to_tiles`` cannot place."""
    return px.where(~(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)))


def cut_tiles(images: DataFrame, size: int = SIZE) -> DataFrame:
    """Split (image_id, width, height, channels, data) rows into tiles."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                pixels = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                rows = []
                for y in range(0, r.height, size):
                    for x in range(0, r.width, size):
                        block = pixels[y:y + size, x:x + size]
                        rows.append((r.image_id, y // size, x // size, y, x, *block.shape[:2], 0, 0, r.channels, r.width, r.height, block.tobytes()))
                yield pd.DataFrame(rows, columns=NAMES)

    return images.mapInPandas(split, TILES)


def _tile(row: tuple) -> pa.Table:
    return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, _TILE)], schema=_TILE)


def pixels_to_tiles(px: DataFrame, channels: Sequence[str], width: int, height: int, size: int = SIZE) -> DataFrame:
    """Tiles from pixel rows (image_id, x, y, channel columns); unset pixels are zero.

    Rows outside the image are not placed; ``outside`` lists them.
    """
    images = px.select("image_id").distinct().select("image_id", F.lit(width).alias("width"), F.lit(height).alias("height"))
    return sized_tiles(px, channels, images, size)


def sized_tiles(px: DataFrame, channels: Sequence[str], images: DataFrame, size: int = SIZE) -> DataFrame:
    """Tiles of all ``images`` (image_id, width, height) from pixel rows; unset pixels are zero, and images may be empty."""
    names = list(channels)

    def build(group: pa.Table) -> pa.Table:
        image, ty, tx, width, height = (group.column(c)[0].as_py() for c in ("image_id", "ty", "tx", "width", "height"))
        h, w = min(size, height - ty * size), min(size, width - tx * size)
        block = np.zeros((h, w, len(names)), np.uint8)
        at = group.column("y").to_numpy() - ty * size, group.column("x").to_numpy() - tx * size
        for k, name in enumerate(names):
            block[(*at, k)] = group.column(name).to_numpy()
        return _tile((image, ty, tx, ty * size, tx * size, h, w, 0, 0, len(names), width, height, block.tobytes()))

    shapes = images.select(F.col("image_id").cast("string").alias("image_id"), F.col("width").cast("int"), F.col("height").cast("int"))
    placed = px.select(F.col("image_id").cast("string").alias("image_id"), "x", "y", *names).join(shapes, "image_id").where(
        "x between 0 and width - 1 and y between 0 and height - 1").select(
        "image_id", "width", "height", "x", "y", *names,
        F.floor(F.col("y") / size).cast("int").alias("ty"), F.floor(F.col("x") / size).cast("int").alias("tx"))

    def steps(length):
        return F.explode(F.sequence(F.lit(0), F.floor((F.col(length) - 1) / size).cast("int")))

    grid = shapes.where("width > 0 and height > 0").withColumn("ty", steps("height")).withColumn("tx", steps("width"))
    # The first pixel of every tile is present, so empty tiles exist too.
    corners = grid.select(
        "image_id", "width", "height", (F.col("tx") * size).alias("x"), (F.col("ty") * size).alias("y"), *[F.lit(0).alias(c) for c in names], "ty", "tx"
    )
    filled = placed.unionByName(corners).groupBy("image_id", "width", "height", "ty", "tx", "x", "y").agg(*[F.max(c).alias(c) for c in names])
    return spread(filled, "image_id", "ty", "tx").groupBy("image_id", "ty", "tx").applyInArrow(build, TILES)


def tile_pixels(tiles: DataFrame, names: Sequence[str], keep_zero: bool = False) -> DataFrame:
    """Pixel rows (image_id, x, y, channel columns) of tiles, without all-zero pixels."""
    names = list(names)

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                block = np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, r.channels)
                hit = np.ones(block.shape[:2], bool) if keep_zero else block.any(axis=2)
                y, x = np.nonzero(hit)
                frame = pd.DataFrame({"image_id": r.image_id, "x": (x + r.x0).astype("int32"), "y": (y + r.y0).astype("int32")})
                for i, name in enumerate(names):
                    frame[name] = block[y, x, i].astype("int32")
                yield frame

    schema = "image_id string, x int, y int, " + ", ".join(f"{n} int" for n in names)
    return tiles.mapInPandas(expand, schema)


def _pieces(tiles: DataFrame, radius: int, size: int) -> DataFrame:
    """Every tile for itself and the strips its neighbours inside the image need."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                block = np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, r.channels)
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        if not (0 <= (r.ty + dy) * size < r.height and 0 <= (r.tx + dx) * size < r.width):
                            continue
                        ys = {-1: slice(0, radius), 0: slice(None), 1: slice(max(0, r.h - radius), r.h)}[dy]
                        xs = {-1: slice(0, radius), 0: slice(None), 1: slice(max(0, r.w - radius), r.w)}[dx]
                        part = block[ys, xs]
                        oy, ox = (ys.start or 0), (xs.start or 0)
                        rows.append((r.image_id, r.ty + dy, r.tx + dx, r.y0 + oy, r.x0 + ox, *part.shape[:2], r.channels, r.width, r.height, part.tobytes()))
            yield pd.DataFrame(rows, columns=["image_id", "ty", "tx", "py", "px", "h", "w", "channels", "width", "height", "data"])

    return tiles.mapInPandas(split, _PIECE)


def filter_tiles(tiles: DataFrame, radius: int, apply: Callable[[np.ndarray, int], np.ndarray], size: int = SIZE) -> DataFrame:
    """Run ``apply(block with a border of radius, radius)`` on every tile.

    Borders outside the image repeat the edge. ``radius`` must not exceed the tile size.
    """
    if radius > size:
        raise ValueError("the filter radius must not exceed the tile size")

    def assemble(group: pa.Table) -> pa.Table:
        parts = group.to_pylist()
        image, ty, tx, width, height, channels = (parts[0][c] for c in ("image_id", "ty", "tx", "width", "height", "channels"))
        y0, x0 = ty * size, tx * size
        h, w = min(size, height - y0), min(size, width - x0)
        top, left = max(0, y0 - radius), max(0, x0 - radius)
        bottom, right = min(height, y0 + h + radius), min(width, x0 + w + radius)
        area = np.zeros((bottom - top, right - left, channels), np.uint8)
        for r in parts:
            part = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"], r["channels"])
            area[r["py"] - top:r["py"] - top + r["h"], r["px"] - left:r["px"] - left + r["w"]] = part
        pad = ((radius - (y0 - top), y0 + h + radius - bottom), (radius - (x0 - left), x0 + w + radius - right), (0, 0))
        result = apply(np.pad(area, pad, mode="edge"), radius)
        result = result.reshape(h, w, -1).astype(np.uint8)
        return _tile((image, ty, tx, y0, x0, h, w, 0, 0, result.shape[2], width, height, result.tobytes()))

    keys = ("image_id", "ty", "tx")
    return spread(_pieces(tiles, radius, size), *keys).groupBy(*keys).applyInArrow(assemble, TILES)


def _box_count(mask: np.ndarray, radius: int) -> np.ndarray:
    total = np.zeros((*mask.shape[:-2], mask.shape[-2] + 1, mask.shape[-1] + 1), np.int32)
    total[..., 1:, 1:] = mask.cumsum(-2, dtype=np.int32).cumsum(-1)
    k = 2 * radius + 1
    return total[..., k:, k:] - total[..., :-k, k:] - total[..., k:, :-k] + total[..., :-k, :-k]


def _median(channel: np.ndarray, radius: int) -> np.ndarray:
    """Exact window median: the lowest level that half of the window does not exceed.

    Levels are counted in blocks of about a million places.
    """
    shape = (channel.shape[0] - 2 * radius, channel.shape[1] - 2 * radius)
    out, found = np.zeros(shape, np.uint8), np.zeros(shape, bool)
    need = ((2 * radius + 1) ** 2 + 1) // 2
    levels, many = np.unique(channel), max(1, 2**20 // channel.size)
    for k in range(0, len(levels), many):
        some = levels[k:k + many]
        hit = _box_count(channel <= some[:, None, None], radius) >= need
        new = ~found & hit.any(axis=0)
        out[new], found = some[hit.argmax(axis=0)][new], found | new
        if found.all():
            break
    return out


def median_filter(block: np.ndarray, radius: int) -> np.ndarray:
    return np.stack([_median(block[..., c], radius) for c in range(block.shape[2])], axis=2)


def _less_background(block: np.ndarray, radius: int) -> np.ndarray:
    inner = block[radius:-radius, radius:-radius].astype(np.int16)
    return np.maximum(inner - median_filter(block, radius), 0)


def _smooth_gray(block: np.ndarray, radius: int) -> np.ndarray:
    smooth = median_filter(block, radius).astype(np.float64)
    if smooth.shape[2] == 1:
        return smooth
    return np.floor(smooth @ np.array([0.114, 0.587, 0.299]) + 0.5)[..., None]


def remove_gradient(tiles: DataFrame, radius: int = 50, smooth: int = 2, size: int = SIZE) -> DataFrame:
    """Subtract the wide median of each channel, smooth and turn to grey."""
    return filter_tiles(filter_tiles(tiles, radius, _less_background, size), smooth, _smooth_gray, size)


def _edge_levels(low: float, high: float) -> Callable[[np.ndarray, int], np.ndarray]:
    """1 for a weak and 2 for a strong edge pixel after non-maximum suppression (Canny, 1986)."""
    def apply(block: np.ndarray, radius: int) -> np.ndarray:
        a = block[..., 0].astype(np.int32) if block.shape[2] == 1 else np.floor(block @ np.array([0.114, 0.587, 0.299]) + 0.5).astype(np.int32)
        gx = (a[:-2, 2:] + 2 * a[1:-1, 2:] + a[2:, 2:]) - (a[:-2, :-2] + 2 * a[1:-1, :-2] + a[2:, :-2])
        gy = (a[2:, :-2] + 2 * a[2:, 1:-1] + a[2:, 2:]) - (a[:-2, :-2] + 2 * a[:-2, 1:-1] + a[:-2, 2:])
        m = np.abs(gx) + np.abs(gy)
        gx, gy, c = gx[1:-1, 1:-1], gy[1:-1, 1:-1], m[1:-1, 1:-1]
        angle = np.rad2deg(np.arctan2(np.abs(gy), np.abs(gx)))
        flat, steep = angle < 22.5, angle > 67.5
        same = (gx < 0) == (gy < 0)
        before = np.select([flat, steep, same], [m[1:-1, :-2], m[:-2, 1:-1], m[:-2, :-2]], m[:-2, 2:])
        after = np.select([flat, steep, same], [m[1:-1, 2:], m[2:, 1:-1], m[2:, 2:]], m[2:, :-2])
        peak = (c > before) & np.where(flat | steep, c >= after, c > after) & (c > low)
        return np.where(peak, np.where(c > high, 2, 1), 0)

    return apply


def edge_pixels(tiles: DataFrame, low: float = 100, high: float = 200, size: int = SIZE) -> DataFrame:
    """(image_id, x, y): weak edge pixels connected to a strong one, and the strong ones."""
    from phenoframe.operators.components import label_pixels

    marks = cut(tile_pixels(filter_tiles(tiles, 2, _edge_levels(low, high), size), ["level"]), "marks")
    labelled = label_pixels(marks, ["image_id"]).join(marks.hint("merge"), ["image_id", "x", "y"])
    strong = labelled.where("level = 2").select("image_id", "label").distinct()
    return labelled.join(strong, ["image_id", "label"], "left_semi").select("image_id", "x", "y")


def extract_pixels(px: DataFrame, boxes: DataFrame, image: str, value: str | Sequence[str]) -> DataFrame:
    """Crop and rotate pixel rows by bilinear sampling: (image, x, y, value or values).

    ``boxes`` has (image, out_w, out_h, to_source): one affine map from output to source pixels
    per image. Positions outside the source count as zero. Aligned crops fall on single pixels.
    """
    m, values = F.col("to_source"), [value] if isinstance(value, str) else list(value)
    # Boxes are few and their pixels many: rows of the grid are dealt to all tasks before they grow to pixels.
    lines = spread(boxes.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("out_h") - 1))), image, "y")
    grid = lines.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("out_w") - 1)))
    src = grid.select(
        image, "x", "y", F.round(m[0] * F.col("x") + m[1] * F.col("y") + m[2], 9).alias("_sx"),
        F.round(m[3] * F.col("x") + m[4] * F.col("y") + m[5], 9).alias("_sy"),
    )
    fx, fy = F.floor("_sx").cast("int"), F.floor("_sy").cast("int")
    wx, wy = F.col("_sx") - fx, F.col("_sy") - fy
    corners = F.array(
        *[
            F.struct((fx + i).alias("cx"), (fy + j).alias("cy"), ((wx if i else 1.0 - wx) * (wy if j else 1.0 - wy)).alias("wt"))
            for i in (0, 1) for j in (0, 1)
        ]
    )
    wanted = src.select(image, "x", "y", F.explode(F.filter(corners, lambda c: c["wt"] > 0)).alias("_c")).select(
        image, "x", "y", "_c.cx", "_c.cy", "_c.wt"
    )
    source = px.select(image, F.col("x").alias("cx"), F.col("y").alias("cy"), *[F.col(v).alias(f"_v_{v}") for v in values])
    # Spark's size of ``wanted`` is that of the boxes, so it would be broadcast however many pixels they hold.
    return wanted.join(source.hint("merge"), [image, "cx", "cy"]).groupBy(image, "x", "y").agg(
        *[F.round(F.sum(F.col(f"_v_{v}") * F.col("wt"))).cast("int").alias(v) for v in values]
    )


def load_masks(spark: SparkSession, folder: str) -> DataFrame:
    """(group_id, width, height, x, y) of the non-zero pixels of ``<code>_mask.png`` files."""
    images = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", "*_mask.png").load(folder).select("image.*")
    tiles = cut_tiles(images.select(F.col("origin").alias("image_id"), "width", "height", F.col("nChannels").alias("channels"), "data"))
    sizes = images.select(F.col("origin").alias("image_id"), "width", "height")
    marks = tile_pixels(tiles, ["v"]).where("v > 0")
    code = F.regexp_extract("image_id", r"([^/]+)_mask\.png$", 1)
    return marks.join(sizes, "image_id").select(code.alias("group_id"), "width", "height", "x", "y")
