"""Bindings of region filters, plate bounds, first occurrences and upward tips."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoframe.operators import orientation, regions
from phenoframe.plans.imaging import PIX, quantity_pixels
from phenoframe.plans.registry import query, table
from phenoframe.runtime import cut

REGIONS = f"""{PIX}, r AS (SELECT image, x // 16 * 4 + y // 16 AS label, x, y FROM q WHERE v > 30),
b AS (SELECT *, EXISTS (SELECT 1 FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(i, j) WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.image = r.image AND o.label = r.label AND o.x = r.x + i AND o.y = r.y + j)) AS edge FROM r),
k AS (SELECT image, label, x + i AS cx, y + j AS cy, count(*) AS n FROM r, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) d(i, j) GROUP BY 1, 2, 3, 4),
e AS (SELECT image, label, sum(CASE n WHEN 4 THEN 1.0 WHEN 3 THEN 0.5 ELSE 0.0 END) AS enclosed FROM k GROUP BY 1, 2),
s AS (SELECT image, label, count(*) AS area, count(*) FILTER (edge) AS boundary, any_value(enclosed) AS enclosed, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM b JOIN e USING (image, label) GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN boundary <= 60 THEN 'boundary' WHEN enclosed <= 20 THEN 'area' END AS reason FROM s)"""


def block_regions(spark, folder):
    """Pixels of higher quantities, with the 16 by 16 block they lie in as their region."""
    label = F.floor(F.col("x") / 16) * 4 + F.floor(F.col("y") / 16)
    return quantity_pixels(spark, folder, 30).select("image", label.alias("label"), "x", "y")


@query("region_filter", f"WITH {REGIONS} SELECT image, label, area, boundary, CAST(enclosed AS DOUBLE) AS enclosed, min_x, max_x, min_y, max_y, reason FROM f")
def region_filter(spark, folder):
    return regions.region_filter(block_regions(spark, folder), ["image"], 60, 20.0)


@query("top_edge", f"WITH {REGIONS} SELECT i.image, CAST(coalesce(min(min_y), 0) AS INTEGER) AS top FROM (SELECT DISTINCT l_linenumber AS image FROM lineitem) i LEFT JOIN f ON f.image = i.image AND reason IS NULL AND f.image % 2 = 1 GROUP BY 1")
def top_edge(spark, folder):
    """Even images have no stems."""
    found = regions.region_filter(block_regions(spark, folder).where("image % 2 = 1"), ["image"], 60, 20.0)
    images = table(spark, folder, "lineitem").select(F.col("l_linenumber").alias("image"))
    return regions.top_edge(found, images, ["image"])


@query("plate_bounds", f"""WITH {REGIONS}, big AS (SELECT * FROM s WHERE enclosed > 75 AND image <> 3), i AS (SELECT DISTINCT l_linenumber AS image FROM lineitem),
one AS (SELECT * FROM big QUALIFY row_number() OVER (PARTITION BY image ORDER BY enclosed DESC, label) = 1),
al AS (SELECT image, min(min_x) AS min_x, max(max_x) AS max_x, min(min_y) AS min_y, max(max_y) AS max_y FROM big GROUP BY 1),
u AS (SELECT 'largest' AS mode, i.image, min_x, max_x, min_y, max_y FROM i LEFT JOIN one USING (image) UNION ALL SELECT 'all', i.image, min_x, max_x, min_y, max_y FROM i LEFT JOIN al USING (image))
SELECT mode, image, CAST(coalesce(min_x, 0) AS INTEGER) AS x, CAST(coalesce(min_y, 0) AS INTEGER) AS y, CAST(coalesce(max_x - min_x + 1, 64) AS INTEGER) AS width, CAST(coalesce(max_y - min_y + 1, 64) AS INTEGER) AS height FROM u""")
def plate_bounds(spark, folder):
    """Bounds by the largest region and by all large ones; image 3 has none."""
    sizes = cut(regions.region_sizes(block_regions(spark, folder).where("image <> 3"), ["image"]), "sizes")
    images = table(spark, folder, "lineitem").select(F.col("l_linenumber").alias("image")).distinct().select(
        "image", F.lit(64).alias("width"), F.lit(64).alias("height"))
    found = [
        regions.plate_bounds(sizes, images, ["image"], union, 75.0).select(F.lit(mode).alias("mode"), "image", "x", "y", "width", "height")
        for mode, union in (("largest", False), ("all", True))]
    return found[0].unionByName(found[1])


@query("first_occurrences", """SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def first_occurrences(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return regions.first_occurrences(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


TIPS = """s AS (SELECT p_partkey % 13 AS img, p_partkey // 13 AS i, p_partkey AS seg, p_size AS z, p_partkey AS key FROM part),
n AS (SELECT *, CASE WHEN i % 4 <> 0 THEN 100 + i % 5 END AS uj, CASE WHEN i % 3 <> 2 THEN i // 6 END AS lj, key * 3 % 90 AS ux, key * 5 % 80 AS uy, key * 7 % 90 AS lx, key * 11 % 80 AS ly, 10.0 + z AS len FROM s),
p AS (SELECT n.*, CASE WHEN i % 11 = 0 THEN -1 WHEN i % 5 = 0 THEN NULL WHEN EXISTS (SELECT 1 FROM s o WHERE o.img = n.img AND o.i = (n.i * 2 + 1) % 40) THEN (i * 2 + 1) % 40 * 13 + img END AS parent, key * 13 % 90 AS px, key * 17 % 80 AS py FROM n),
w AS (SELECT seg AS start, seg, parent, [seg] AS seen FROM p UNION ALL SELECT w.start, p.seg, p.parent, list_append(w.seen, p.seg) FROM w JOIN p ON p.seg = w.parent WHERE NOT list_contains(w.seen, p.seg)),
lp AS (SELECT DISTINCT start FROM w WHERE list_contains(seen, parent)),
t AS (SELECT * FROM p WHERE uj IS NULL AND lj IS NOT NULL AND coalesce(parent, 0) >= 0 AND (parent IS NULL OR sqrt((ux - px) ** 2 + (uy - py) ** 2) > len) AND z % 7 <> 3),
a AS (SELECT * FROM p WHERE lj IS NOT NULL AND z % 5 <> 1),
c AS (SELECT t.img, t.seg, a.seg AS arrival, sqrt((a.lx - t.lx) ** 2 + (a.ly - t.ly) ** 2) AS near FROM t JOIN a ON a.img = t.img AND a.lj = t.lj AND a.seg <> t.seg
  WHERE (a.seg NOT IN (SELECT seg FROM t) OR a.seg > t.seg) AND NOT EXISTS (SELECT 1 FROM w WHERE w.start = a.seg AND w.seg = t.seg))"""


@query("terminal_orientation", f"WITH RECURSIVE {TIPS} SELECT img, seg, arrival AS anchor FROM c QUALIFY row_number() OVER (PARTITION BY img, seg ORDER BY near, arrival) = 1")
def terminal_orientation(spark, folder):
    """Parts as segments with free upper ends and shared junctions at the lower ones."""
    key, z = F.col("p_partkey"), F.col("p_size")
    i = F.floor(key / 13)
    place = {"upper_x": key * 3 % 90, "upper_y": key * 5 % 80, "lower_x": key * 7 % 90, "lower_y": key * 11 % 80}
    rows = table(spark, folder, "part").select(
        (key % 13).alias("img"), i.alias("i"), key.alias("seg"), z.alias("z"), F.when(i % 4 != 0, 100 + i % 5).alias("upper_junction"),
        F.when(i % 3 != 2, F.floor(i / 6)).alias("lower_junction"), *[v.alias(n) for n, v in place.items()], (10.0 + z).alias("length"),
        ((i * 2 + 1) % 40 * 13 + key % 13).alias("_up"), (key * 13 % 90).alias("parent_x"), (key * 17 % 80).alias("parent_y"))
    known = rows.select(F.col("seg").alias("_up"), F.lit(True).alias("_known"))
    rows = cut(rows.join(known, "_up", "left").withColumn(
        "parent", F.when(F.col("i") % 11 == 0, -1).when(F.col("i") % 5 != 0, F.when(F.col("_known"), F.col("_up")))), "tips")
    links = rows.select("img", "seg", "parent", "parent_x", "parent_y")
    segments = rows.drop("i", "_up", "_known", "parent", "parent_x", "parent_y", "z")
    return orientation.upward_tips(segments, links, rows.where("z % 5 <> 1"), rows.where("z % 7 = 3"), ["img"])
