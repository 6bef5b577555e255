"""Bindings of search frames, plate crops and stems found again with stored maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoframe.functions import geometry as g
from phenoframe.operators import stems
from phenoframe.plans.registry import query, table
from phenoframe.runtime import cut

# Quarter turns and boxes without rotation: maps are whole numbers and halves, so both sides agree to the last digit.
CROPS = """s AS (SELECT p_partkey AS id, CAST(40 + 2 * (p_partkey % 30) AS DOUBLE) AS w, CAST(30 + 2 * p_size AS DOUBLE) AS h, p_partkey % 4 AS q, p_partkey % 3 = 0 AS own FROM part),
f AS (SELECT *, CASE WHEN own THEN w / 2 WHEN q % 2 = 0 THEN w ELSE h END AS sw, CASE WHEN own THEN h / 2 WHEN q % 2 = 0 THEN h ELSE w END AS sh,
  CASE WHEN own THEN 0 ELSE q END AS k, CASE WHEN own THEN w / 4 ELSE 0 END AS ox, CASE WHEN own THEN h / 4 ELSE 0 END AS oy FROM s),
b AS (SELECT *, CAST(id % 7 AS DOUBLE) AS x, CAST(id % 5 AS DOUBLE) AS y, sw - id % 7 - 3 AS bw, sh - id % 5 - 2 AS bh FROM f),
c AS (SELECT *, x + CASE WHEN i IN (1, 2) THEN bw ELSE 0 END AS cx, y + CASE WHEN i IN (2, 3) THEN bh ELSE 0 END AS cy FROM b, range(4) r(i)),
o AS (SELECT *, CASE k WHEN 0 THEN cx + ox WHEN 1 THEN cy WHEN 2 THEN w - cx ELSE w - cy END AS px, CASE k WHEN 0 THEN cy + oy WHEN 1 THEN h - cx WHEN 2 THEN h - cy ELSE cx END AS py FROM c)"""


@query("plate_crop", f"""WITH {CROPS} SELECT id, i AS corner, round(px, 6) AS px, round(py, 6) AS py, CAST(sw AS INTEGER) AS frame_w, CAST(sh AS INTEGER) AS frame_h,
CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(bw AS INTEGER) AS width, CAST(bh AS INTEGER) AS height,
round(CASE k WHEN 0 THEN -ox WHEN 1 THEN h - 1 WHEN 2 THEN w - 1 ELSE 0 END - x, 6) AS shift_x, round(CASE k WHEN 0 THEN -oy WHEN 1 THEN 0 WHEN 2 THEN h - 1 ELSE w - 1 END - y, 6) AS shift_y,
CASE WHEN own THEN 0.5 WHEN k % 2 = 0 THEN 1.0 ELSE round(h / w, 6) END::DOUBLE AS search_w FROM o""")
def plate_crop(spark, folder):
    """Parts as images turned by quarters or with a box of their own; bounds go to the image and back."""
    key = F.col("p_partkey")
    rows = table(spark, folder, "part").select(
        key.alias("id"), (40 + 2 * (key % 30)).cast("double").alias("w"), (30 + 2 * F.col("p_size")).cast("double").alias("h"),
        (key % 4 * 90.0).alias("deg"), F.when(key % 3 == 0, g.box(*[F.lit(v) for v in (0.5, 0.5, 0.5, 0.5, 0.0)])).alias("own"))
    size = F.col("w"), F.col("h"), F.col("deg"), F.col("own")
    # Parts are small rows with much work each, so they are dealt to all cores; each map is worked out once and written.
    rows = rows.repartition(2 * spark.sparkContext.defaultParallelism, "id")
    rows = cut(rows.withColumn("frame", g.search_frame(*size)).withColumn("search", g.search_box(*size)), "frames")
    rows = rows.withColumn("bounds", F.struct(
        (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"),
        (F.col("frame.w") - F.col("id") % 7 - 3).alias("width"), (F.col("frame.h") - F.col("id") % 5 - 2).alias("height")))
    rows = cut(rows.withColumn("outline", g.plate_outline(F.col("bounds"), F.col("frame.m"))), "outlines")
    rows = cut(rows.withColumn("crop", g.plate_crop(F.col("outline"), F.col("frame.m"))), "crops")
    shift = F.col("crop.to_plate")
    return rows.select("*", F.posexplode("outline").alias("corner", "p")).select(
        "id", F.col("corner").cast("long").alias("corner"), F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"), F.col("frame.w").alias("frame_w"),
        F.col("frame.h").alias("frame_h"), "crop.x", "crop.y", "crop.width", "crop.height", F.round(shift[2], 6).alias("shift_x"), F.round(shift[5], 6).alias("shift_y"),
        F.round("search.w", 6).alias("search_w"))


@query("analysis_box", """WITH s AS (SELECT p_partkey AS id, CAST(100 + p_partkey % 400 AS DOUBLE) AS w, CAST(90 + 3 * p_size AS DOUBLE) AS h, p_partkey % 5 / 20.0 AS t, 1 - p_partkey % 3 / 10.0 AS b, p_size / 200.0 AS m FROM part),
f AS (SELECT *, round_even(h * t, 0) AS first, round_even(h * b, 0) - round_even(h * t, 0) AS part FROM s),
e AS (SELECT *, round_even(m * part, 0) AS up, round_even(0.05 * part, 0) AS down, round_even(m * w, 0) AS l, round_even(0.03 * w, 0) AS r FROM f),
x AS (SELECT *, greatest(1.0, w - l - r) AS bw, greatest(1.0, part - up - down) AS bh FROM e)
SELECT id, CASE WHEN id % 11 = 0 THEN 0.5 ELSE round((l + bw / 2) / w, 9) END AS cx, CASE WHEN id % 11 = 0 THEN 0.5 ELSE round((first + up + bh / 2) / h, 9) END AS cy,
CASE WHEN id % 11 = 0 THEN 0.25 ELSE round(bw / w, 9) END AS width, CASE WHEN id % 11 = 0 THEN 0.25 ELSE round(bh / h, 9) END AS height FROM x""")
def analysis_box(spark, folder):
    key, size = F.col("p_partkey"), F.col("p_size")
    margins = F.struct((size / 200.0).alias("top"), F.lit(0.05).alias("bottom"), (size / 200.0).alias("left"), F.lit(0.03).alias("right"))
    own = F.when(key % 11 == 0, g.box(*[F.lit(v) for v in (0.5, 0.5, 0.25, 0.25, 0.0)]))
    found = g.analysis_box((100 + key % 400).cast("double"), (90 + 3 * size).cast("double"), key % 5 / 20.0, 1 - key % 3 / 10.0, margins, own)
    return table(spark, folder, "part").select(key.alias("id"), found.alias("b")).select(
        "id", F.round("b.cx", 9).alias("cx"), F.round("b.cy", 9).alias("cy"), F.round("b.w", 9).alias("width"), F.round("b.h", 9).alias("height"))


@query("redetect_stems", """WITH r AS (SELECT l_suppkey % 40 AS image, l_partkey % 6 AS s, l_orderkey % 60 AS y0, CAST(l_quantity AS BIGINT) AS area FROM lineitem),
ok AS (SELECT image FROM (SELECT DISTINCT image FROM r) WHERE image // 5 NOT IN (2, 5)),
n AS (SELECT image, s, count(*) AS n, CAST(round_even(quantile_cont(y0 + 3.0, 0.5), 0) AS INTEGER) AS y, sum(area) AS area FROM r JOIN ok USING (image) GROUP BY 1, 2)
SELECT image, CAST(s AS INTEGER) AS slot, CAST(round_even((100 * s + 4) + 0.25 * image, 0) + round_even(image % 3 * 0.75, 0) AS INTEGER) AS x, CAST(y - 7 + (image % 4 - 2) AS INTEGER) AS y, CAST(area AS BIGINT) AS area FROM n""")
def redetect_stems(spark, folder):
    """Six columns of regions for each image; groups of five images, one without a map, one with changed settings."""
    image, x0 = F.col("l_suppkey") % 40, (F.col("l_partkey") % 6 * 100).cast("int")
    line = table(spark, folder, "lineitem")
    y0 = (F.col("l_orderkey") % 60).cast("int")
    regions = line.select(
        image.alias("image"), x0.alias("min_x"), (x0 + 7).alias("max_x"), y0.alias("min_y"), (y0 + 5).alias("max_y"), F.col("l_quantity").cast("long").alias("area"))
    i = F.col("image")
    one, no = F.lit(1.0), F.lit(0.0)
    images = line.select(image.alias("image")).distinct().select(
        "image", F.floor(i / 5).alias("grp"), F.array(one, no, 0.25 * i, no, one, F.lit(-7.0)).alias("to_crop"),
        F.when(i != 12, F.array(one, no, 0.25 * i + i % 3 * 0.75, no, one, -7.0 + i % 4 - 2)).alias("to_stored"))
    state = images.select("grp").distinct().select("grp", F.lit("b").alias("prepare_hash"), F.when(F.col("grp") == 5, "a").when(F.col("grp") != 4, "b").alias("stored_hash"))
    return stems.redetect_stems(regions, images, state, ["grp"], ["image"], 6)
