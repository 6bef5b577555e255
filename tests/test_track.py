"""Two plants over three frames with closed-form lengths."""

import tempfile

from pyspark.sql import functions as F

from phenoframe.plans import track as tr


DEPTHS = (30, 45)


def scene():
    """Each plant grows a straight vertical root; plant 0 gets a slanted side root on day two."""
    rows = []
    for frame, depth in enumerate(DEPTHS):
        for x in (40, 120):
            for y in range(12, 12 + depth):
                rows += [("g", frame, x + d, y, 50) for d in (-1, 0, 1)]
        if frame:
            for k in range(1, 24):
                rows += [("g", frame, 40 + k + d, 25 + k, 50) for d in (-1, 0, 1)]
        # a stationary object away from the stems
        rows += [("g", frame, 80 + i, 100 + j, 50) for i in range(4) for j in range(30)]
    return rows


def test_track_two_plants(spark):
    levels = spark.createDataFrame(scene(), "group_id string, frame int, x int, y int, v int").distinct()
    levels = levels.unionByName(levels.withColumn("group_id", F.lit("h")))
    stems = spark.createDataFrame(
        [(g, o, x, 10) for g in "gh" for o, x in ((0, 40), (1, 120))], "group_id string, owner int, x int, y int"
    )
    options = tr.TrackOptions(width=160, height=160, spacing=80.0, min_area=20)
    out = tr.track(levels, stems, options, tempfile.mkdtemp(prefix="spark-"))
    rows = {(r.group_id, r.frame, r.owner): r for r in out.collect()}
    assert len(rows) == 8
    for (group, frame, owner), r in rows.items():
        assert abs(r.plant_main_root_depth - DEPTHS[frame]) <= 6, r
        if owner == 1:
            assert abs(r.plant_total_length - DEPTHS[frame]) <= 6, r
            assert r.root_count == 1, r
        elif frame:
            assert r.plant_total_length > r.plant_main_root_length + 8, r
        assert rows["g", frame, owner].plant_total_length == rows["h", frame, owner].plant_total_length

    images = spark.createDataFrame(
        [(g, f, f"2024-01-0{1 + f} 10:00:00", f"{g}{f}.jpg", "", g) for g in "gh" for f in (0, 1)],
        "group_id string, frame int, d string, path string, code_read string, expected_code string",
    ).withColumn("date", F.to_timestamp_ntz("d"))
    growth = images.select("group_id", "frame", F.lit(10).alias("new_area"), F.lit(1).alias("new_parts"))
    stats = {(r.image_path, r.plant_id): r for r in tr.statistics(out, images, growth).collect()}
    assert stats["g0.jpg", 1].plant_total_length_RGR is None
    assert stats["g1.jpg", 2].plant_total_length_RGR > 0.2
