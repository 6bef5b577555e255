"""Bindings of ownership measures, junction ends, directions and masked axes."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoframe.operators import edits, evidence, linking, luminance, measure, order, runs
from phenoframe.plans.geometry import LINES, line_axes
from phenoframe.plans.imaging import PIX, quantity_pixels
from phenoframe.plans.registry import query, table
from phenoframe.plans.tracking import SERIES, event_series

OWNED = "ow AS (SELECT l_linenumber AS image, l_suppkey % 4 AS owner, CAST(l_partkey % 64 AS INTEGER) AS x, CAST(l_orderkey % 64 AS INTEGER) AS y, l_quantity AS v FROM lineitem)"


def owned_pixels(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_linenumber").alias("image"), (F.col("l_suppkey") % 4).alias("owner"), (F.col("l_partkey") % 64).cast("int").alias("x"),
        (F.col("l_orderkey") % 64).cast("int").alias("y"), F.col("l_quantity").alias("v"),
    )


@query("image_totals", f"WITH {PIX} SELECT image, count(*) FILTER (v > 20) AS image_total_area, count(*) FILTER (v > 45) AS image_total_length FROM q GROUP BY 1")
def image_totals(spark, folder):
    px = quantity_pixels(spark, folder)
    return measure.image_totals(px.where("v > 20"), px.where("v > 45"), ["image"])


@query("owned_lengths", f"""WITH {OWNED}, o AS (SELECT image, owner, count(DISTINCT x * 64 + y) AS plant_total_length, min(y) AS top FROM ow WHERE v > 20 GROUP BY 1, 2),
m AS (SELECT image, owner, count(DISTINCT x * 64 + y) AS main, max(y) AS tip FROM ow WHERE v > 49 GROUP BY 1, 2)
SELECT image, owner, plant_total_length, coalesce(main, 0) AS plant_main_root_length, CAST(coalesce(tip - top, 0) AS INTEGER) AS plant_main_root_depth FROM o LEFT JOIN m USING (image, owner)""")
def owned_lengths(spark, folder):
    px = owned_pixels(spark, folder)
    return measure.owned_lengths(px.where("v > 20"), px.where("v > 49"), ["image"], "owner")


@query("root_counts", f"""WITH {OWNED}, s AS (SELECT image, owner, x AS lower_x, y AS lower_y FROM ow WHERE v > 40), t AS (SELECT DISTINCT image, x, y FROM ow WHERE v < 5), e AS (SELECT DISTINCT image, y AS x, x AS y FROM ow WHERE v < 5)
SELECT s.image, owner, count(*) FILTER (t.x IS NULL) AS root_count, count(*) FILTER (e.x IS NULL) AS tip_count FROM s
LEFT JOIN t ON t.image = s.image AND t.x = lower_x AND t.y = lower_y LEFT JOIN e ON e.image = s.image AND e.x = lower_x AND e.y = lower_y GROUP BY 1, 2""")
def root_counts(spark, folder):
    px = owned_pixels(spark, folder)
    segments = px.where("v > 40").select("image", "owner", F.col("x").alias("lower_x"), F.col("y").alias("lower_y"))
    links = px.where("v < 5").select(
        "image", F.col("x").alias("child_x"), F.col("y").alias("child_y"), F.col("y").alias("parent_x"), F.col("x").alias("parent_y")
    )
    return measure.root_counts(segments, links, ["image"], "owner")


@query("end_junctions", f"""WITH {PIX}, j AS (SELECT image, x, y, CAST(x // 4 AS BIGINT) AS label FROM px), e AS (SELECT image, x, y FROM q WHERE v < 4)
SELECT e.image, e.x, e.y, min(label) AS junction FROM e JOIN j ON j.image = e.image AND abs(j.x - e.x) <= 1 AND abs(j.y - e.y) <= 1 GROUP BY 1, 2, 3 HAVING count(DISTINCT label) = 1""")
def end_junctions(spark, folder):
    px = quantity_pixels(spark, folder)
    marks = px.where("v > 45").withColumn("label", F.floor(F.col("x") / 4))
    return linking.end_junctions(px.where("v < 4"), marks, ["image"])


@query("exact_overlap", f"""WITH {OWNED}, p AS (SELECT DISTINCT image, x, y FROM ow WHERE v > 45), h AS (SELECT DISTINCT image + 1 AS image, owner, x, y FROM ow WHERE v > 40)
SELECT p.image, CAST(p.y // 8 AS BIGINT) AS seg, min(owner) AS owner FROM p JOIN h ON p.image = h.image AND p.x = h.x AND p.y = h.y GROUP BY 1, 2""")
def exact_overlap(spark, folder):
    px = owned_pixels(spark, folder)
    points = px.where("v > 45").select("image", "x", "y", F.floor(F.col("y") / 8).alias("seg")).distinct()
    history = px.where("v > 40").select((F.col("image") + 1).alias("image"), "owner", "x", "y").distinct()
    return linking.forced_owners(points, history, ["image"])


@query("least_turn", """WITH o AS (SELECT l_orderkey AS k, l_linenumber AS owner, CAST(l_partkey % 360 AS DOUBLE) AS i, CAST(l_orderkey % 360 AS DOUBLE) AS g FROM lineitem),
t AS (SELECT k, owner, abs((g - i + 540) % 360 - 180) AS turn FROM o), b AS (SELECT k, min(turn) AS m FROM t GROUP BY 1)
SELECT t.k, min(owner) AS owner, min(turn) AS turn FROM t JOIN b ON t.k = b.k AND turn = m GROUP BY 1 HAVING count(*) = 1""")
def least_turn(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("owner"), (F.col("l_partkey") % 360).cast("double").alias("i"),
        (F.col("l_orderkey") % 360).cast("double").alias("g"),
    )
    return evidence.least_turn(rows, ["k"], "owner", "i", "g")


@query("line_direction", f"""WITH {SERIES}, n AS (SELECT *, lead(value) OVER w AS nv FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
p AS (SELECT user_id, pos, pos * 1.0::DOUBLE AS ax, value AS ay, pos + 1.0::DOUBLE AS bx, nv AS by_ FROM n WHERE pos BETWEEN 5 AND 24 AND nv IS NOT NULL),
s AS (SELECT user_id, count(*) AS w, sum((ax + bx) / 2) / count(*) AS mx, sum((ay + by_) / 2) / count(*) AS my, sum((ax*ax + bx*bx) / 3 + ax*bx / 3) / count(*) AS xx,
  sum((ay*ay + by_*by_) / 3 + ay*by_ / 3) / count(*) AS yy, sum((ax*ay + bx*by_) / 3 + (ax*by_ + bx*ay) / 6) / count(*) AS xy, max(bx) - min(ax) AS ex, arg_max(by_, pos) - arg_min(ay, pos) AS ey FROM p GROUP BY 1),
a AS (SELECT *, atan2(2 * (xy - mx * my), (xx - mx * mx) - (yy - my * my)) / 2 AS t FROM s)
SELECT user_id, round((degrees(t) + CASE WHEN cos(t) * ex + sin(t) * ey < 0 THEN 180 ELSE 0 END + 360) % 360, 4) AS direction FROM a""")
def line_direction(spark, folder):
    points = event_series(spark, folder).select("user_id", "pos", F.col("pos").cast("double").alias("x"), F.col("value").alias("y"))
    joined = runs.next_point(points, ["user_id"], "pos", "x", "y").where("_nx is not null").withColumn(
        "arc", F.col("pos").cast("double")
    ).withColumn("_narc", F.col("pos") + 1.0)
    out = evidence.line_direction(joined, ["user_id"], "arc", F.lit(5.0), F.lit(25.0))
    return out.select("user_id", F.round("direction", 4).alias("direction"))


@query("level_bridges", """WITH s AS (SELECT p_partkey AS seg, p_partkey % 5 AS img, p_partkey % 23 AS a, p_partkey * 7 % 29 AS b, p_size % 3 = 0 AS lvl, CAST(p_size AS DOUBLE) AS len FROM part),
i AS (SELECT img, b AS j, count(*) AS n FROM s GROUP BY 1, 2), o AS (SELECT img, a AS j, count(*) AS n FROM s GROUP BY 1, 2)
SELECT s.seg, s.img, s.a AS upper_junction, s.b AS lower_junction FROM s JOIN i i1 ON i1.img = s.img AND i1.j = a JOIN o o1 ON o1.img = s.img AND o1.j = a JOIN i i2 ON i2.img = s.img AND i2.j = b JOIN o o2 ON o2.img = s.img AND o2.j = b
WHERE lvl AND a <> b AND len < 25 AND o1.n > 1 AND i2.n > 1""")
def level_bridges(spark, folder):
    key, size = F.col("p_partkey"), F.col("p_size")
    segs = table(spark, folder, "part").select(
        key.alias("seg"), (key % 5).alias("img"), (key % 23).alias("upper_junction"), (key * 7 % 29).alias("lower_junction"),
        F.lit(0).alias("upper_y"), (size % 3).alias("lower_y"), size.cast("double").alias("length"), F.lit(12.0).alias("first_width"), F.lit(13.0).alias("last_width"),
    )
    return order.level_bridges(segs, ["img"])


@query("masked_axes", f"""WITH {LINES}, a AS (SELECT conv_id, image, CASE WHEN is_lateral THEN conv_id - 1 END AS parent FROM axes), v AS (SELECT a.*, k.piece FROM a, (VALUES (1), (2)) k(piece) WHERE conv_id % 5 <> 2 AND (k.piece = 1 OR conv_id % 3 = 0)),
n AS (SELECT conv_id, count(*) AS n_pieces FROM v GROUP BY 1)
SELECT v.image, v.conv_id AS source_index, v.piece, n.n_pieces, CASE WHEN p.conv_id IS NOT NULL THEN v.parent END AS parent_source, CASE WHEN p.conv_id IS NOT NULL THEN 1 END AS parent_piece
FROM v JOIN n ON n.conv_id = v.conv_id LEFT JOIN n p ON p.conv_id = v.parent AND v.parent // 12 = v.image""")
def masked_axes(spark, folder):
    axes = line_axes(spark, folder).select("image", "conv_id", "parent")
    pieces = axes.where("conv_id % 5 <> 2").withColumn(
        "piece", F.explode(F.when(F.col("conv_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    )
    return edits.masked_axes(pieces, axes, ["image"], "conv_id", "parent")


@query("largest_part", "SELECT p_brand, arg_max(p_partkey, p_retailprice * 100000 - p_partkey / 1000000.0) AS p_partkey FROM part GROUP BY 1")
def largest_part(spark, folder):
    return luminance.largest(table(spark, folder, "part"), ["p_brand"], F.col("p_retailprice"), ["p_partkey"])
