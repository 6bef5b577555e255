"""Main axis scenes. All scenes of a kind run together as groups of one table."""

import pytest
from pyspark.sql import functions as F

from phenoframe.operators import forest, mainaxis

STROKE = "img string, owner int, seg long, parent long, upper_x int, upper_y int, lower_x int, lower_y int, upper_junction long, lower_junction long, component long"


def pixels(x0, y0, x1, y1):
    n = max(abs(x1 - x0), abs(y1 - y0), 1)
    return [(round(x0 + (x1 - x0) * k / n), round(y0 + (y1 - y0) * k / n)) for k in range(n + 1)]


def axis(spark, scenes, history, roots=None):
    """{scene: segments of the main axis}; scenes are {name: [(seg, parent, x0, y0, x1, y1, junctions...)]}."""
    strokes = [(name, 0, seg, parent, *ends, *(tuple(rest) + (None, None, None))[:3]) for name, rows in scenes.items() for seg, parent, ends, *rest in rows]
    table = spark.createDataFrame(strokes, STROKE)
    points = spark.createDataFrame(
        [(r[0], r[2], k, x, y, 4.0) for r in strokes for k, (x, y) in enumerate(pixels(*r[4:8]))], "img string, seg long, pos long, x int, y int, width double")

    def marks(places):
        return None if places is None else spark.createDataFrame([(n, 0, x, y) for n, ps in places.items() for x, y in ps], "img string, owner int, x int, y int")

    got = mainaxis.main_axis(table.select("img", "owner", "seg", "parent"), table.drop("owner", "parent"), points, marks(history), ["img"], marks(roots))
    out = {name: set() for name in scenes}
    for r in got.select("img", "seg").distinct().collect():
        out[r.img].add(r.seg)
    return out


def test_chains_have_no_depth_limit(spark):
    links = spark.range(600).select(F.lit("g").alias("k"), "id", F.when(F.col("id") > 0, F.col("id") - 1).otherwise(-7).alias("up"), F.col("id").alias("v"))
    totals, jumps = forest.chain_totals(links, ["k"], "id", "up", ["v"])
    assert {r.id: r.v for r in totals.collect()} == {i: i * (i + 1) // 2 for i in range(600)}
    start = spark.createDataFrame([("g", 599, 599), ("g", 3, 3)], "k string, tip long, id long")
    members = forest.chain_members(start, jumps, ["k"], "id").groupBy("tip").agg(F.count("*").alias("n"), F.count_distinct("id").alias("m"))
    assert {(r.tip, r.n, r.m) for r in members.collect()} == {(599, 600, 600), (3, 4, 4)}
    below = forest.with_descendant(start.where("id = 3").select("k", "id"), jumps, ["k"], "id")
    assert {r.id for r in below.collect()} == {0, 1, 2, 3}
    circle = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 3, 1), ("h", 1, 0)], "k string, id long, up long")
    with pytest.raises(ValueError):
        forest.chain_totals(circle, ["k"], "id", "up")


def test_main_axis_scenes(spark):
    trunk, side = (1, -1, (30, 0, 30, 50)), (3, 1, (31, 51, 90, 140))
    scenes = {
        "first": [trunk, (2, 1, (30, 51, 30, 90)), side],
        "overtaken": [trunk, (2, 1, (30, 51, 30, 90)), side],
        "split": [(1, -1, (31, 0, 31, 50)), (2, 1, (31, 51, 31, 70)), (4, 2, (31, 71, 31, 99)), side],
        # Two arrivals at junction 5: the owner's base link leads to the side root.
        "rejoined": [trunk, (2, 1, (30, 51, 30, 80), None, 5), (3, 1, (31, 51, 60, 80), None, 5), (6, 3, (30, 81, 30, 120), 5)],
        # An established main with a gap in it; both parts hang on the stem.
        "gap": [(1, -1, (30, 0, 30, 40)), (2, -1, (30, 52, 30, 110)), (3, -1, (45, 0, 80, 130), 9)],
        # The gap leads across, not along.
        "no gap": [(1, -1, (30, 0, 30, 40)), (2, -1, (75, 52, 75, 80))],
        # A long basal link to another root's top is not followed.
        "basal": [(1, -1, (90, 0, 90, 20), None, None, 1), (2, 1, (30, 40, 30, 100), None, None, 2)],
    }
    line = [(30, y) for y in range(91)]
    history = {name: line for name in scenes if name not in ("first", "no gap")}
    history["rejoined"] = [(30, y) for y in range(111)]
    history["basal"] = [(30, y) for y in range(40, 91)]
    assert axis(spark, scenes, history) == {
        "first": {1, 3}, "overtaken": {1, 2}, "split": {1, 2, 4}, "rejoined": {1, 2, 6}, "gap": {1, 2}, "no gap": {2}, "basal": {2}}


def test_main_axis_keeps_roles_and_recovers(spark):
    trunk = (1, -1, (30, 0, 30, 40))
    scenes = {
        # The lower half was a lateral before: it cannot become the main axis now.
        "lateral": [trunk, (2, 1, (30, 41, 30, 70)), (3, 1, (31, 41, 70, 100))],
        # A short side root lies on the old line after the main has moved: its votes would cut the axis short.
        "moved": [(1, -1, (30, 0, 30, 20)), (2, 1, (30, 21, 30, 50)), (3, 1, (34, 21, 34, 120))],
        # Nothing was seen in the frame before: no recovery.
        "unseen": [(1, -1, (30, 0, 30, 20)), (2, 1, (30, 21, 30, 50)), (3, 1, (34, 21, 34, 120))],
    }
    history = {"lateral": [(30, y) for y in range(71)], "moved": [(30, y) for y in range(116)], "unseen": [(30, y) for y in range(116)]}
    roots = {"lateral": history["lateral"] + [(31 + k, 41 + round(k * 59 / 39)) for k in range(40)], "moved": history["moved"], "unseen": [(200, 200)]}
    assert axis(spark, scenes, history, roots) == {"lateral": {1, 2}, "moved": {1, 3}, "unseen": {1, 2}}


def test_main_portions_of_merged_segments(spark):
    # Segment 1 begins on a lateral root and runs into the main one at row 20; segment 2 is lateral only.
    points = spark.createDataFrame(
        [(1, 1, k, 50, k, 2.0) for k in range(60)] + [(1, 2, k, 90, k, 2.0) for k in range(30)] + [(1, 3, k, 120, k, 2.0) for k in range(9)],
        "owner int, seg int, pos long, x int, y int, width double")
    main = spark.createDataFrame([(1, 50, y) for y in range(20, 60)], "owner int, x int, y int")
    side = spark.createDataFrame([(1, 51, y) for y in range(0, 16)] + [(1, 90, y) for y in range(12)] + [(1, 50, 40)], "owner int, x int, y int")
    kept = {(r.seg, r.pos) for r in mainaxis.main_portions(points, main, side, ["owner"]).collect()}
    # Rows 0 to 16 are near the lateral one (within a diagonal step), 17 is nearer to it than to the main one at 19.
    assert kept == {(1, k) for k in range(18, 60)} | {(3, k) for k in range(9)}
    bridge = spark.createDataFrame([(1, 2)], "owner int, seg int")
    saved = {(r.seg, r.pos) for r in mainaxis.main_portions(points, main, side, ["owner"], bridge).collect()}
    assert saved == kept | {(2, k) for k in range(30)}
