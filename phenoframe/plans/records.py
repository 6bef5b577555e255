"""Bindings of documents, parameters, tiles, stems and ownership."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoframe.functions import geometry as fg
from phenoframe.operators import linking, measure, order, stems, tiles
from phenoframe.params import Params, settings_table, violations
from phenoframe.plans.geometry import line_points
from phenoframe.plans.imaging import PIX, quantity_pixels
from phenoframe.plans.registry import query, table
from phenoframe.runtime import cut
from phenoframe.sources import documents

DOCS = """d AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer)"""


def xml_files(spark, folder):
    """One small document per customer: a main axis with a child, and sometimes a broken one."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    def point(x, y):
        return F.concat(F.lit('<point x="'), x.cast("string"), F.lit('" y="'), y.cast("string"), F.lit('"/>'))
    axis = F.concat(
        F.lit("<rsml><metadata><unit>pixel</unit><resolution>"), F.when(k % 17 == 0, "-1").otherwise("2.5"),
        F.lit('</resolution></metadata><scene><plant id="'), n.cast("string"), F.lit('"><root id="m"><geometry><polyline>'),
        point(F.lit(10), F.lit(10)), point(F.lit(10), 20 + n), F.lit('</polyline></geometry><root id="c"><geometry><polyline>'),
        point(F.lit(10), F.lit(15)), point(F.lit(13), F.when(k % 19 == 0, F.lit("nan")).otherwise("19")),
        F.lit("</polyline></geometry></root></root></plant></scene></rsml>"),
    )
    text = F.when(k % 23 == 0, F.concat(F.lit("<!DOCTYPE x [<!ENTITY a 'b'>]>"), axis)).when(k % 29 == 0, F.lit("<rsml>")).otherwise(axis)
    return table(spark, folder, "customer").select(k.cast("string").alias("path"), F.encode(text, "utf-8").alias("content"))


@query("parse_documents", f"""WITH {DOCS}, g AS (SELECT *, CASE WHEN k % 23 = 0 THEN 'DTD or entity' WHEN k % 29 = 0 THEN 'not well-formed' WHEN k % 17 = 0 THEN 'resolution' WHEN k % 19 = 0 THEN 'invalid polyline' END AS reason FROM d)
SELECT CAST(k AS VARCHAR) AS path, CAST(n AS VARCHAR) AS plant_id, CAST(r.i AS DOUBLE) AS root_index, CASE r.i WHEN 1 THEN 0.0 END AS parent_index, CASE r.i WHEN 1 THEN 'm' END AS parent_id,
  CASE r.i WHEN 0 THEN CAST(10 + n AS DOUBLE) ELSE 5.0 END AS length, 2.5 AS resolution, reason FROM g, range(2) r(i) WHERE reason IS NULL
UNION ALL SELECT CAST(k AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, reason FROM g WHERE reason IS NOT NULL""".replace("2.5 AS resolution", "CAST(2.5 AS DOUBLE) AS resolution").replace("THEN 0.0 END", "THEN CAST(0 AS DOUBLE) END").replace("ELSE 5.0 END", "ELSE CAST(5 AS DOUBLE) END"))
def parse_documents(spark, folder):
    axes = documents.parse_documents(xml_files(spark, folder))
    rows = measure.axis_geometry(axes)
    return rows.select(
        "path", "plant_id", F.col("root_index").cast("double").alias("root_index"), F.col("parent_index").cast("double").alias("parent_index"),
        "parent_id", F.when(F.col("reason").isNull(), F.col("length")).alias("length"), "resolution", "reason",
    )


@query("geometry_export", """WITH p AS (SELECT conv_id // 12 AS img, conv_id, turn, turn * 10 AS x, length(text) % 500 AS y FROM conversations)
SELECT img AS frame_no, CAST(2 + 2 * count(DISTINCT conv_id % 3 + 1) + 2 * count(DISTINCT conv_id) + count(*) AS BIGINT) AS n_lines,
  CAST(sum(length('<point x="' || x || '" y="' || y || '"/>')) AS BIGINT) AS point_chars FROM p GROUP BY 1""")
def geometry_export(spark, folder):
    points = line_points(spark, folder).select(
        F.lit("g").alias("group_id"), F.floor(F.col("conv_id") / 12).alias("frame_no"), (F.col("conv_id") % 3 + 1).alias("plant"),
        F.col("conv_id").alias("path"), F.col("turn").alias("pos"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"),
    )
    single = points.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("path")
    points = points.join(single, "path", "left_semi")
    images = points.select("group_id", "frame_no").distinct().withColumn("file_name", F.lit("a.jpg")).withColumn(
        "date", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    )
    lines = documents.geometry_lines(points, images)
    chars = F.when(F.col("value").startswith("<point"), F.length("value")).otherwise(0)
    return lines.groupBy("frame_no").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(chars.cast("long")).alias("point_chars"))


@query("export_gate", f"WITH {PIX} SELECT image, count(*) AS n_bad FROM q WHERE x >= 40 + image OR y >= 60 GROUP BY 1")
def export_gate(spark, folder):
    px = quantity_pixels(spark, folder)
    images = px.select("image").distinct().withColumn("width", 40 + F.col("image")).withColumn("height", F.lit(60))
    return documents.export_gate(px, images, ["image"])


@query("settings_violations", """WITH s AS (SELECT c_custkey AS grp, c_custkey % 40 AS low, CAST(c_nationkey AS DOUBLE) / 20 AS mt, c_custkey % 9 AS k FROM customer)
SELECT grp, 'thresholds out of order' AS violation FROM s WHERE low > 30
UNION ALL SELECT grp, 'margin_top outside 0..1' FROM s WHERE mt > 1
UNION ALL SELECT grp, 'opposite margins leave nothing' FROM s WHERE mt + CAST(0.05 AS DOUBLE) >= 1
UNION ALL SELECT grp, 'no plants' FROM s WHERE k < 1
UNION ALL SELECT grp, 'green range' FROM s WHERE grp % 50 = 3""")
def settings_violations(spark, folder):
    rows = table(spark, folder, "customer").withColumnRenamed("c_custkey", "grp")
    settings = settings_table(rows, "grp", Params()).join(rows.select("grp", "c_nationkey"), "grp")
    settings = settings.withColumns({
        "threshold_low": (F.col("grp") % 40).cast("int"), "margin_top": F.col("c_nationkey") / 20.0, "n_clusters": (F.col("grp") % 9).cast("int"),
        "green_hsv_lower": F.when(F.col("grp") % 50 == 3, F.array(F.lit(28), F.lit(256), F.lit(50))).otherwise(F.col("green_hsv_lower")),
    })
    return violations(settings, "grp")


GRID = f"""{PIX}, full_grid AS (SELECT i.image, CAST(x.x AS INTEGER) AS x, CAST(y.y AS INTEGER) AS y, CAST(coalesce(floor(q.v * 5), 0) AS INTEGER) AS v
  FROM (SELECT DISTINCT image FROM q) i CROSS JOIN range(64) x(x) CROSS JOIN range(64) y(y) LEFT JOIN q ON q.image = i.image AND q.x = x.x AND q.y = y.y)"""


def level_tiles(spark, folder, size):
    px = quantity_pixels(spark, folder).select(F.col("image").alias("image_id"), "x", "y", F.floor(F.col("v") * 5).cast("int").alias("v"))
    return tiles.pixels_to_tiles(px, ["v"], 64, 64, size)


@query("tile_background", f"""WITH {GRID}, med AS (SELECT g.image, g.x, g.y, any_value(g.v) AS v, CAST(quantile_cont(n.v, 0.5) AS INTEGER) AS m FROM full_grid g CROSS JOIN range(-2, 3) i(i) CROSS JOIN range(-2, 3) j(j)
  JOIN full_grid n ON n.image = g.image AND n.x = least(63, greatest(0, g.x + i.i)) AND n.y = least(63, greatest(0, g.y + j.j)) GROUP BY 1, 2, 3)
SELECT CAST(image AS VARCHAR) AS image_id, x, y, greatest(v - m, 0) AS v FROM med WHERE v > m""")
def tile_background(spark, folder):
    """Tiles of 16 pixels, so most windows reach into neighbouring tiles."""
    cleaned = tiles.filter_tiles(level_tiles(spark, folder, 16), 2, tiles._less_background, 16)
    return tiles.tile_pixels(cleaned, ["v"])


@query("tile_edges")
def tile_edges(spark, folder):
    return tiles.edge_pixels(level_tiles(spark, folder, 32), 100, 200, 32)


@query("extract_box", f"""WITH {GRID}, m AS (SELECT cos(radians(30.0)) AS c, sin(radians(30.0)) AS s),
o AS (SELECT CAST(x.x AS INTEGER) AS x, CAST(y.y AS INTEGER) AS y, round(c * x.x - s * y.y + (32 - 0.5 - c * 19 / 2 + s * 15 / 2), 9) AS sx, round(s * x.x + c * y.y + (32 - 0.5 - s * 19 / 2 - c * 15 / 2), 9) AS sy FROM m, range(20) x(x), range(16) y(y)),
f AS (SELECT *, CAST(floor(sx) AS INTEGER) AS fx, CAST(floor(sy) AS INTEGER) AS fy FROM o)
SELECT g.image, f.x, f.y, CAST(round(sum(g.v * (CASE WHEN i.i = 1 THEN sx - fx ELSE 1 - (sx - fx) END) * (CASE WHEN j.j = 1 THEN sy - fy ELSE 1 - (sy - fy) END))) AS INTEGER) AS v
FROM f CROSS JOIN range(2) i(i) CROSS JOIN range(2) j(j) JOIN full_grid g ON g.x = f.fx + i.i AND g.y = f.fy + j.j GROUP BY 1, 2, 3""")
def extract_box(spark, folder):
    px = quantity_pixels(spark, folder).select("image", "x", "y", F.floor(F.col("v") * 5).cast("int").alias("v"))
    box = fg.box(F.lit(0.5), F.lit(0.5), F.lit(20 / 64), F.lit(16 / 64), F.lit(30.0))
    e = fg.box_extraction(box, F.lit(64.0), F.lit(64.0))
    boxes = px.select("image").distinct().withColumn("e", e).select("image", "e.out_w", "e.out_h", "e.to_source")
    out = tiles.extract_pixels(px, boxes, "image", "v")
    # Unset pixels count as zero: an output pixel surrounded by them is zero as well.
    grid = boxes.select("image", F.explode(F.sequence(F.lit(0), F.col("out_w") - 1)).alias("x"), "out_h").select(
        "image", "x", F.explode(F.sequence(F.lit(0), F.col("out_h") - 1)).alias("y")
    )
    return grid.join(out, ["image", "x", "y"], "left").na.fill(0, ["v"])


@query("stem_clusters")
def stem_clusters(spark, folder):
    key = F.col("l_partkey")
    x0, y0 = (key * 37 % 900).cast("int"), (F.col("l_orderkey") % 60).cast("int")
    regions = table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("image"), x0.alias("min_x"), (x0 + F.col("l_linenumber")).alias("max_x"), y0.alias("min_y"),
        (y0 + 5).alias("max_y"), F.col("l_quantity").cast("long").alias("area"),
    )
    return stems.cluster_stems(regions, ["image"], 6)


@query("dependency_levels", """WITH RECURSIVE n AS (SELECT c_custkey AS k, CASE WHEN c_custkey > 0 THEN c_custkey // 3 END AS p FROM customer),
l AS (SELECT k, 0 AS level FROM n WHERE p IS NULL UNION ALL SELECT n.k, l.level + 1 FROM n JOIN l ON n.p = l.k) SELECT k AS child, CAST(level AS INTEGER) AS level FROM l""")
def dependency_levels(spark, folder):
    key = F.col("c_custkey")
    links = table(spark, folder, "customer").select(key.alias("child"), F.when(key > 0, F.floor(key / 3)).alias("parent"))
    return order.dependency_levels(links, [], "child", "parent")


@query("junction_clusters", """WITH RECURSIVE b AS (SELECT p_partkey AS seg, p_partkey % 97 AS a, p_partkey * 5 % 89 AS c FROM part WHERE p_partkey % 97 <> p_partkey * 5 % 89),
e AS (SELECT a, c FROM b UNION SELECT c, a FROM b), r AS (SELECT a AS j, a AS cur FROM e UNION SELECT r.j, e.c FROM r JOIN e ON r.cur = e.a)
SELECT j AS junction, min(cur) AS cluster FROM r GROUP BY 1""")
def junction_clusters(spark, folder):
    key = F.col("p_partkey")
    bridges = table(spark, folder, "part").select(
        key.alias("seg"), (key % 97).alias("upper_junction"), (key * 5 % 89).alias("lower_junction")
    )
    return order.merge_junctions(bridges, [])


def part_segments(spark, folder):
    """Segments and stems laid out from the parts table: about 2,000 at the check scale."""
    key = F.col("p_partkey")
    ux, uy = (key * 13 % 600).cast("int"), (20 + key * 29 % 130).cast("int")
    lx, ly = (ux + F.col("p_size") % 9 - 4).cast("int"), (uy + 8 + F.col("p_size") % 20).cast("int")
    def cell(x, y):
        # An end joins the junction of the next band down, so links run downwards.
        return (F.floor(x / 60) * 100 + F.floor(y / 128)).cast("long")
    segs = table(spark, folder, "part").select(
        (key % 11).alias("img"), (key + 1000).cast("long").alias("seg"), ux.alias("upper_x"), uy.alias("upper_y"),
        lx.alias("lower_x"), ly.alias("lower_y"),
        F.lit(270.0).alias("upper_angle"), (60 + F.col("p_size")).cast("double").alias("lower_angle"),
        F.when(key % 4 == 0, cell(ux, uy)).alias("upper_junction"), F.when(key % 4 == 1, cell(lx, ly) + 1).alias("lower_junction"),
        (key % 10 == 3).alias("lower_is_tip"), F.lit(None).cast("long").alias("component"),
    )
    roots = segs.select("img").distinct().select("img", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("owner")).withColumn(
        "x", (50 + F.col("owner") * 100).cast("int")
    ).withColumn("y", F.lit(10))
    return segs, roots


def part_links(spark, folder):
    segs, roots = part_segments(spark, folder)
    segs = cut(segs, "segments")
    forced = segs.where("seg % 7 = 0").select("img", "seg", (F.col("seg") % 6).cast("int").alias("owner"))
    return segs, roots, linking.link_rounds(segs, roots, forced, segs, ["img"], 100.0, 1024, gate=False)


@query("rooted_links")
def rooted_links(spark, folder):
    return part_links(spark, folder)[2]


@query("junction_routing")
def junction_routing(spark, folder):
    segs, roots, links = part_links(spark, folder)
    support = segs.where("seg % 5 = 0").select("img", "seg", (F.col("seg") % 6).cast("int").alias("support_owner"), F.lit(0.7).alias("share"))
    return linking.route(segs, cut(links, "links"), roots, support, ["img"])
