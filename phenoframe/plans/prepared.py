"""Bindings of the preparation of whole images."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoframe.functions import geometry as g
from phenoframe.operators import overlay, tiles
from phenoframe.params import Crop, Green, Params
from phenoframe.plans.prepare import CHANNELS, prepare
from phenoframe.plans.registry import query, table
from phenoframe.runtime import cut, spread

# One image of 48 by 40 for each 4,000 order keys: a blue plate, three stems (two in each fourth image) and one bright
# pixel for each line item on the plate. Odd images are upside down. A grown stem that reaches the border of its plate
# is not cut back there (``re``).
PARAMS = Params(
    margin_top=0.1, margin_bottom=0.05, margin_left=0.1, margin_right=0.03, n_clusters=3, green=Green(min_count=5, min_area=20),
    crop=Crop(top_ratio=0.0, bottom_ratio=1.0))
SCENES = """i AS (SELECT DISTINCT l_orderkey // 4000 AS i FROM lineitem),
v AS (SELECT l_orderkey // 4000 AS i, l_partkey % 48 AS x, l_orderkey % 40 AS y, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3),
d AS (SELECT *, 7 AS px, 6 AS py, 34 - i % 3 AS pw, 28 AS ph FROM i),
t AS (SELECT *, CASE WHEN gx + 6 >= pw - 1 THEN pw - 1 ELSE gx + 5 END AS re FROM (SELECT i, pw, 4 + 11 * s AS gx, 7 + (i + s) % 5 AS gy FROM d, range(3) r(s) WHERE i % 4 <> 3 OR s < 2)),
c AS (SELECT *, CAST(round_even(0.1 * pw, 0) AS INTEGER) AS l, CAST(round_even(0.1 * ph, 0) AS INTEGER) AS up, CAST(pw - round_even(0.1 * pw, 0) - round_even(0.03 * pw, 0) AS INTEGER) AS w,
  CAST(ph - round_even(0.1 * ph, 0) - round_even(0.05 * ph, 0) AS INTEGER) AS h FROM d)"""


def scenes(spark, folder):
    """(pixels, images) of the scenes that SCENES describes; boxes are null."""
    line = table(spark, folder, "lineitem")
    i, x, y = F.col("i"), F.col("x"), F.col("y")
    bright = line.groupBy((F.floor(F.col("l_orderkey") / 4000)).alias("i"), (F.col("l_partkey") % 48).cast("int").alias("x"), (F.col("l_orderkey") % 40).cast("int").alias("y")).agg(
        F.max("l_quantity").cast("int").alias("v"))
    images = line.select(F.floor(F.col("l_orderkey") / 4000).alias("i")).distinct()
    lines = spread(images.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(39)))), "i", "y")
    grid = lines.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(47))))
    px = grid.join(bright, ["i", "x", "y"], "left")
    on_plate = x.between(4, 43 - i % 3) & y.between(3, 36)
    stem = F.lit(False)
    for s in range(3):
        at, down = 7 + 4 + 11 * s, 6 + 7 + (i + s) % 5
        stem = stem | (x.between(at, at + 3) & y.between(down, down + 2) & ((i % 4 != 3) if s == 2 else F.lit(True)))
    light = F.lit(100) + F.coalesce("v", F.lit(0))
    colour = F.when(stem, F.array(F.lit(0), F.lit(200), F.lit(166))).when(on_plate, F.array(F.lit(200), light, light)).otherwise(F.array(F.lit(0), F.lit(0), F.lit(150)))
    down = i % 2 == 1
    px = px.withColumn("_c", colour).select(
        i.cast("string").alias("image_id"), F.when(down, 47 - x).otherwise(x).alias("x"), F.when(down, 39 - y).otherwise(y).alias("y"),
        *[F.col("_c")[k].alias(c) for k, c in enumerate(CHANNELS)])
    none = F.lit(None).cast("struct<cx:double,cy:double,w:double,h:double,deg:double>")
    return px, images.select(
        i.cast("string").alias("image_id"), F.lit(48).alias("width"), F.lit(40).alias("height"), F.when(down, 180.0).otherwise(0.0).alias("degrees"), none.alias("search"), none.alias("own"))


@query("prepared_stems", f"""WITH {SCENES},
z AS (SELECT c.i, sum(CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.i = c.i AND gx.x - c.px BETWEEN t.gx - 2 AND t.re AND gy.y - c.py BETWEEN t.gy - 2 AND t.gy + 4) THEN 0
  ELSE 100 + coalesce(v.v, 0) END) AS light FROM c JOIN range(48) gx(x) ON gx.x - c.px BETWEEN c.l AND c.l + c.w - 1 JOIN range(40) gy(y) ON gy.y - c.py BETWEEN c.up AND c.up + c.h - 1
  LEFT JOIN v ON v.i = c.i AND v.x = gx.x AND v.y = gy.y GROUP BY 1)
SELECT CAST(c.i AS VARCHAR) AS image_id, c.px::INTEGER AS plate_x, c.py::INTEGER AS plate_y, c.pw::INTEGER AS plate_width, c.ph::INTEGER AS plate_height, c.w AS width, c.h AS height, CAST(z.light AS BIGINT) AS light,
CASE WHEN c.i % 4 = 3 THEN 'fewer stems than plants' END AS reason, CAST((t.gx - 4) // 11 AS INTEGER) AS slot, CAST(round_even((t.gx - 1 + t.re) / 2.0, 0) - c.l AS INTEGER) AS x, CAST(round_even(t.gy + 1.5, 0) - c.up AS INTEGER) AS y, CAST(7 * (t.re - t.gx + 3) AS BIGINT) AS area
FROM c JOIN z USING (i) LEFT JOIN t ON t.i = c.i AND c.i % 4 <> 3""")
def prepared_stems(spark, folder):
    """Plates, analysis boxes, light without stems, and stems of all scenes."""
    done = prepare(*scenes(spark, folder), PARAMS, radius=4, size=32)
    light = done.erased.groupBy("image_id").agg(F.sum("g").alias("light"))
    return done.images.join(light, "image_id").join(done.stems, "image_id", "left").select(
        "image_id", "plate_x", "plate_y", "plate_width", "plate_height", "width", "height", "light", "reason", F.col("slot").cast("int").alias("slot"), "x", "y", "area")


@query("prepared_pixels")
def prepared_pixels(spark, folder):
    """Grey level and edge pixels of each prepared scene (``tests/test_prepare.py`` holds them against a plain version)."""
    done = prepare(*scenes(spark, folder), PARAMS, radius=4, size=32)
    done = done._replace(process=cut(done.process, "process"))  # read for the grey levels and for the edges
    grey = tiles.tile_pixels(done.process, ["v"]).groupBy("image_id").agg(F.sum("v").alias("grey"))
    edges = done.edges(32).groupBy("image_id").agg(F.count(F.lit(1)).alias("edges"))
    return done.images.select("image_id").join(grey, "image_id", "left").join(edges, "image_id", "left").na.fill(0)


@query("copy_settings", """WITH s AS (SELECT s_suppkey AS grp, s_nationkey % 4 * 90 AS rotation, s_suppkey % 3 AS low FROM supplier),
t AS (SELECT * FROM s, (VALUES ('prepare', 0), ('track', 1), ('measure', 2)) v(stage, k)),
h AS (SELECT *, rotation <> 180 OR (low <> 1 AND k > 0) AS hit FROM t)
SELECT grp, 180 AS rotation, 1 AS low, stage, NOT hit AND grp % 5 <> 0 AS done, CASE WHEN NOT hit THEN 'h' || grp END AS config_hash FROM h""")
def copy_settings(spark, folder):
    """One rotation and one level for all suppliers; stages are stale only where theirs changed."""
    key = F.col("s_suppkey")
    settings = table(spark, folder, "supplier").select(
        key.alias("grp"), (F.col("s_nationkey") % 4 * 90).cast("int").alias("rotation"), (key % 3).cast("int").alias("low"))
    stages = {"prepare": "prepare_hash", "track": "track_hash", "measure": None}
    state = settings.select(
        "grp", F.explode(F.array(*map(F.lit, stages))).alias("stage"), (F.col("grp") % 5 != 0).alias("done"), F.concat(F.lit("h"), F.col("grp").cast("string")).alias("config_hash"))

    def hashes(rows):
        return rows.withColumns({"prepare_hash": overlay.fingerprint(F.col("rotation")), "track_hash": overlay.fingerprint(F.col("low"))})

    copied, marked = overlay.copy_to_all(settings, state, "grp", {"rotation": F.lit(180), "low": F.lit(1)}, hashes, stages)
    return copied.join(marked, "grp").select("grp", "rotation", "low", "stage", "done", "config_hash")
