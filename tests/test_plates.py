"""Split ownership, plate crops and stored maps in small scenes with known answers."""

import pytest
from pyspark.sql import functions as F

from phenoframe.functions import geometry as g
from phenoframe.operators import ownership, stems


def test_fragments_follow_the_owner_through_segments_of_others(spark):
    points = spark.createDataFrame(
        [(0, s, i, 10 * s, 10 * s + i) for s in range(3) for i in range(6)], "img int, seg int, pos int, x int, y int")
    routed = spark.createDataFrame([(0, 0, 1, None), (0, 1, 1, 0), (0, 2, 1, 1), (0, 0, 2, None)], "img int, seg int, owner int, parent int")
    # All of segment 1 and the middle of segment 2 were owner 2's alone; the end of segment 2 was shared.
    held = spark.createDataFrame(
        [(0, 10, 10 + i, 2, True) for i in range(6)] + [(0, 20, 20 + i, 2, True) for i in (2, 3)] + [(0, 20, 25, o, False) for o in (1, 2)],
        "img int, x int, y int, owner int, exclusive boolean")
    want = {
        (0, 1, 1, None, None, 0, 5), (0, 1, 2, None, None, 0, 5), (1, 1, 2, 0, 1, 0, 5), (2, 1, 1, 0, 1, 0, 1),
        (2, 2, 2, 0, 1, 2, 3), (2, 3, 1, 2, 1, 4, 4), (2, 4, 1, 2, 3, 5, 5), (2, 4, 2, 2, 2, 5, 5)}
    got = ownership.historical_fragments(points, routed, held, ["img"]).drop("img")
    assert set(map(tuple, got.select("seg", "fragment", "owner", "parent", "parent_fragment", "first_pos", "last_pos").collect())) == want
    # A proven owner stays beside the earlier one.
    proven = routed.where("seg = 1").select("img", "seg", "owner")
    both = ownership.historical_fragments(points, routed, held, ["img"], proven).where("seg = 1").collect()
    assert {(r.owner, r.parent) for r in both} == {(1, 0), (2, 0)}
    assert ownership.historical_fragments(points.limit(0), routed.limit(0), held.limit(0), ["img"]).count() == 0
    circle = spark.createDataFrame([(0, 0, 1, 1), (0, 1, 1, 0)], "img int, seg int, owner int, parent int")
    with pytest.raises(ValueError):
        ownership._homes(circle, circle.select("img", "seg", "owner", F.lit(1).alias("_last")).limit(0), ["img"])


@pytest.mark.parametrize("degrees", [0.0, 33.0, 180.0, 271.5])
def test_outline_goes_back_to_its_bounds(spark, degrees):
    one = spark.range(1).select(F.lit(90.0).alias("w"), F.lit(60.0).alias("h"), F.lit(degrees).alias("d"), g.box(*[F.lit(v) for v in (0.5, 0.5, 0.4, 0.6, 12.0)]).alias("b"))
    for own in (F.col("b"), F.lit(None).cast(dict(one.dtypes)["b"])):
        frame = one.withColumn("f", g.search_frame(F.col("w"), F.col("h"), F.col("d"), own)).withColumn(
            "bounds", F.struct(F.lit(3.0).alias("x"), F.lit(4.0).alias("y"), F.lit(20.0).alias("width"), F.lit(11.0).alias("height")))
        outline = g.plate_outline(F.col("bounds"), F.col("f.m"))
        row = frame.withColumn("c", g.plate_crop(outline, F.col("f.m"))).first()
        assert (row.c.x, row.c.y, row.c.width, row.c.height) == (3, 4, 20, 11)
        assert row.c.to_plate[2] == pytest.approx(row.f.m[2] - 3) and row.c.to_plate[5] == pytest.approx(row.f.m[5] - 4)


def test_groups_without_maps_are_named(spark):
    images = spark.createDataFrame([(1, [1.0] * 6), (1, None), (2, [1.0] * 6), (3, [1.0] * 6)], "grp int, to_stored array<double>")
    state = spark.createDataFrame([(1, "a", "a"), (2, "b", "a"), (3, "b", None)], "grp int, prepare_hash string, stored_hash string")
    assert {tuple(r) for r in stems.outdated_groups(images, state, ["grp"]).collect()} == {(1, "no stored map"), (2, "settings changed")}
