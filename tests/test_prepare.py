"""Preparation of whole images against a plain version of each step, and its rejects."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoframe.operators import tiles
from phenoframe.plans import prepared
from phenoframe.plans.prepare import prepare
from phenoframe.sources import sinks

def no_box():
    return F.lit(None).cast("struct<cx:double,cy:double,w:double,h:double,deg:double>")


def median(a, r):
    wide = np.pad(a, ((r, r), (r, r), (0, 0)), mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(wide, (2 * r + 1, 2 * r + 1), (0, 1)), axis=(-1, -2))


def grey(block, radius):
    flat = np.maximum(block - median(block, radius), 0)
    return np.floor(median(flat, 2) @ np.array([0.114, 0.587, 0.299]) + 0.5)


def photo(seed, stems, turned):
    """A blue plate in a red frame with green stems, 48 by 40."""
    draw = np.random.default_rng(seed)
    a = np.zeros((40, 48, 3), int)
    a[:] = 0, 0, 150
    a[3:37, 4:44] = 200, 100, 100
    dots = draw.random((40, 48)) < 0.3
    dots[:3] = dots[37:] = dots[:, :4] = dots[:, 44:] = False
    a[dots, 1:] += draw.integers(1, 90, dots.sum())[:, None]
    for s in range(stems):
        a[14 + s: 17 + s, 11 + 11 * s: 15 + 11 * s] = 0, 200, 166
    return a[::-1, ::-1] if turned else a


@pytest.fixture(scope="module")
def done(spark):
    given = {"a": (photo(1, 3, False), 0.0), "b": (photo(1, 3, True), 180.0), "c": (photo(2, 2, False), 0.0)}
    px = [(k, x, y, *map(int, a[y, x])) for k, (a, _) in given.items() for y in range(40) for x in range(48)]
    images = [(k, 48, 40, d) for k, (_, d) in given.items()] + [("lost", 48, 40, 0.0), ("long", 48, 40, 0.0)]
    px += [("long", x, y, 200, 100, 100) for x in range(48) for y in range(40)]
    pixels = spark.createDataFrame(px, "image_id string, x int, y int, b int, g int, r int").repartition(5)
    long = F.when(F.col("image_id") == "long", F.struct(*[F.lit(v).alias(n) for n, v in zip(("cx", "cy", "w", "h", "deg"), (0.5, 0.5, 9.0, 0.5, 0.0))])).otherwise(no_box())
    table = spark.createDataFrame(images, "image_id string, width int, height int, degrees double").withColumns({"search": no_box(), "own": long})
    return prepare(pixels, table, prepared.PARAMS, radius=4, size=16)


def test_every_image_has_a_row_and_a_reason(done):
    rows = {r.image_id: r for r in done.images.collect()}
    assert {k: r.reason for k, r in rows.items()} == {
        "a": None, "b": None, "c": "fewer stems than plants", "lost": "no pixels", "long": "box longer than the image"}
    assert rows["a"][1:7] == rows["b"][1:7] == (7, 6, 34, 28, 30, 24) and rows["lost"].plate_x is None


def test_stems_are_placed_in_the_box_and_erased(done):
    stems = {(r.image_id, r.slot): (r.x, r.y, r.area) for r in done.stems.collect()}
    assert stems == {(k, s): (3 + 11 * s, y, 56) for k in "ab" for s, y in enumerate((7, 7, 9))}
    shown = {(r.image_id, r.x, r.y): (r.b, r.g, r.r) for r in done.display.collect()}
    left = {(r.image_id, r.x, r.y): (r.b, r.g, r.r) for r in done.erased.collect()}
    assert shown.keys() == left.keys() and len(shown) == 3 * 30 * 24
    gone = {k for k in shown if left[k] == (0, 0, 0)}
    assert all(left[k] == shown[k] for k in shown.keys() - gone) and {k[0] for k in gone} == set("abc")


def test_background_leaves_what_the_plain_version_leaves(done):
    left = {}
    for r in done.erased.collect():
        left.setdefault(r.image_id, np.zeros((24, 30, 3)))[r.y, r.x] = r.b, r.g, r.r
    got = {k: np.zeros((24, 30)) for k in left}
    for r in tiles.tile_pixels(done.process, ["v"]).collect():
        got[r.image_id][r.y, r.x] = r.v
    for k, block in left.items():
        assert np.array_equal(got[k], grey(block, 4)), k
    edges = {(r.image_id, r.x, r.y) for r in done.edges(16).collect()}
    assert {e[0] for e in edges} <= set("abc") and all(0 <= x < 30 and 0 <= y < 24 for _, x, y in edges)


def test_no_images(spark, done):
    px = spark.createDataFrame([], "image_id string, x int, y int, b int, g int, r int")
    images = spark.createDataFrame([], "image_id string, width int, height int, degrees double").withColumns({"search": no_box(), "own": no_box()})
    empty = prepare(px, images, prepared.PARAMS, radius=4, size=16)
    assert empty.images.count() == empty.stems.count() == empty.process.count() == 0


def test_masks_are_replaced_by_group(spark, tmp_path):
    kind, target = "group_id string, width int, height int, x int, y int", str(tmp_path / "masks")
    groups = spark.createDataFrame([("a",), ("b",)], "group_id string")
    sinks.save_masks(spark.createDataFrame([("a", 9, 9, 1, 1), ("a", 9, 9, 2, 1), ("b", 9, 9, 3, 3), ("c", 9, 9, 0, 0)], kind), groups, target)
    read = lambda: {(r.group_id, r.x, r.y) for r in sinks.load_masks(spark, target).collect()}
    assert read() == {("a", 1, 1), ("a", 2, 1), ("b", 3, 3)}
    sinks.save_masks(spark.createDataFrame([("b", 9, 9, 4, 4)], kind), groups.where("group_id = 'b'"), target)
    assert read() == {("a", 1, 1), ("a", 2, 1), ("b", 4, 4)}
    sinks.save_masks(spark.createDataFrame([], kind), groups.where("group_id = 'a'"), target)
    assert read() == {("b", 4, 4)}
