"""Bindings of the colour, tone, pixel and component operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoframe.functions import color, tone
from phenoframe.operators import components, luminance, pixels
from phenoframe.plans.registry import query, table

LEVELS = "lv AS (SELECT l_suppkey % 40 AS image, l_linenumber AS grp, CAST(floor(l_quantity * 5) AS INTEGER) AS v FROM lineitem)"


def level_pixels(spark, folder):
    return table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") % 40).alias("image"), F.col("l_linenumber").alias("grp"), F.floor(F.col("l_quantity") * 5).cast("int").alias("v")
    )


STATS = f"""{LEVELS}, st AS (SELECT grp, image, quantile_cont(v, 0.1) AS shadow, quantile_cont(v, 0.5) AS mid, quantile_cont(v, 0.9) AS highlight,
  CAST(sum(v) AS DOUBLE) / count(*) AS mean_luma FROM lv GROUP BY 1, 2)"""


def tones(spark, folder):
    return luminance.tone_stats(level_pixels(spark, folder), ["grp", "image"], "v")


@query("tone_percentiles", f"WITH {STATS} SELECT grp, image, round(shadow, 6) AS shadow, round(mid, 6) AS mid, round(highlight, 6) AS highlight, round(mean_luma, 6) AS mean_luma FROM st")
def tone_percentiles(spark, folder):
    return tones(spark, folder).select("grp", "image", *[F.round(c, 6).alias(c) for c in ("shadow", "mid", "highlight", "mean_luma")])


REFERENCE = """pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY image) - 1 AS j, count(*) OVER (PARTITION BY grp) AS n FROM st) q
  WHERE n <= 12 OR EXISTS (SELECT 1 FROM range(12) r(i) WHERE CAST(floor(i * (n / 12.0)) AS BIGINT) = j)),
ref AS (SELECT grp, avg(shadow) AS s, avg(mid) AS m, avg(highlight) AS h, avg(mean_luma) AS l FROM pick GROUP BY 1)"""


@query("reference_tone", f"WITH {STATS}, {REFERENCE} SELECT grp, round(s, 6) AS shadow, round(m, 6) AS mid, round(h, 6) AS highlight, round(l, 6) AS mean_luma FROM ref")
def reference_tone(spark, folder):
    out = luminance.reference_tone(tones(spark, folder), 12, ["image"], ["grp"])
    return out.select("grp", *[F.round(c, 6).alias(c) for c in ("shadow", "mid", "highlight", "mean_luma")])


@query("tone_match", f"""WITH {STATS}, {REFERENCE}, a AS (SELECT st.*, ref.s, ref.m, ref.h, ref.l, least(100.0, greatest(-100.0, (m + 9 - mid) / 1.275)) AS br FROM st JOIN ref USING (grp)),
b AS (SELECT *, shadow + 1.275 * br AS dark, highlight + 1.275 * br AS bright FROM a),
c AS (SELECT *, least(1.0, greatest(0.0, dark / 255)) AS xs, least(1.0, greatest(0.0, bright / 255)) AS xh FROM b),
d AS (SELECT *, least(100.0, greatest(-100.0, (s + 9 - dark) / (1.275 * greatest((1 - xs) * (1 - xs), 0.05)))) AS sh FROM c),
e AS (SELECT *, least(100.0, greatest(-100.0, (h + 9 - (bright + 1.275 * sh * (1 - xh) * (1 - xh))) / (1.275 * greatest(xh * xh, 0.05)))) AS hi FROM d)
SELECT grp, image, round(br, 4) AS brightness, round(sh, 4) AS shadows, round(hi, 4) AS highlights, round(least(100.0, greatest(-100.0, (l + 9 - mean_luma) / 1.275)), 4) AS brightness_only FROM e""")
def tone_match(spark, folder):
    stats = tones(spark, folder)
    target = luminance.reference_tone(stats, 12, ["image"], ["grp"])
    target = target.select("grp", *[(F.col(c) + 9).alias(c) for c in ("shadow", "mid", "highlight", "mean_luma")])
    out = luminance.match_tone(stats, target, ["grp"])
    return out.select("grp", "image", *[F.round(c, 4).alias(c) for c in ("brightness", "shadows", "highlights", "brightness_only")])


@query("tone_adjust", """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_quantity * 5) AS INTEGER) AS v, CAST(l_suppkey % 5 * 20 - 40 AS DOUBLE) AS b, CAST(l_partkey % 3 * 30 - 30 AS DOUBLE) AS s, CAST(l_orderkey % 3 * 30 - 30 AS DOUBLE) AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, v, CAST(CASE WHEN b = 0 AND s = 0 AND h = 0 THEN v ELSE floor(least(1.0, greatest(0.0, v / 255.0::DOUBLE + b * 0.005::DOUBLE + s * 0.005::DOUBLE * (1 - v / 255.0::DOUBLE) * (1 - v / 255.0::DOUBLE) + h * 0.005::DOUBLE * (v / 255.0::DOUBLE) * (v / 255.0::DOUBLE))) * 255.0::DOUBLE) END AS INTEGER) AS adjusted FROM v""")
def tone_adjust(spark, folder):
    level = F.floor(F.col("l_quantity") * 5)
    b, s, h = [((F.col(c) % k) * m - o).cast("double") for c, k, m, o in (("l_suppkey", 5, 20, 40), ("l_partkey", 3, 30, 30), ("l_orderkey", 3, 30, 30))]
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", level.cast("int").alias("v"), tone.adjust(level.cast("double"), b, s, h).alias("adjusted")
    )


COLOURS = """px AS (SELECT l_orderkey, l_linenumber AS image, l_partkey, CAST(l_partkey * 7 % 256 AS INTEGER) AS b, CAST(l_orderkey * 3 % 256 AS INTEGER) AS g, CAST(l_suppkey * 11 % 256 AS INTEGER) AS r FROM lineitem),
sp AS (SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS d FROM px),
sec AS (SELECT *, CASE WHEN d = 0 THEN 0.0::DOUBLE WHEN v = r THEN 60.0::DOUBLE * (g - b) / d WHEN v = g THEN 120.0 + 60.0::DOUBLE * (b - r) / d ELSE 240.0 + 60.0::DOUBLE * (r - g) / d END AS deg FROM sp),
hsv AS (SELECT *, CAST(round((CASE WHEN deg < 0 THEN deg + 360 ELSE deg END) / 2) AS INTEGER) % 180 AS h, CAST(CASE WHEN v = 0 THEN 0 ELSE round(255.0::DOUBLE * d / v) END AS INTEGER) AS s FROM sec)"""


def colours(spark, folder):
    b, g, r = [(F.col(c) * k % 256).cast("int") for c, k in (("l_partkey", 7), ("l_orderkey", 3), ("l_suppkey", 11))]
    rows = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("image"), "l_partkey", b.alias("b"), g.alias("g"), r.alias("r"))
    return rows.withColumn("_c", color.hsv(F.col("b"), F.col("g"), F.col("r"))).select("*", "_c.h", "_c.s", "_c.v").drop("_c")


@query("colour_spaces", f"WITH {COLOURS} SELECT l_orderkey, image, l_partkey, CAST(round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) AS INTEGER) AS gray, h, s, v FROM hsv")
def colour_spaces(spark, folder):
    return colours(spark, folder).select("l_orderkey", "image", "l_partkey", color.gray(F.col("b"), F.col("g"), F.col("r")).alias("gray"), "h", "s", "v")


@query("colour_mask", f"""WITH {COLOURS} SELECT l_orderkey, image, l_partkey, h BETWEEN 28 AND 42 AND s BETWEEN 100 AND 255 AND v BETWEEN 50 AND 200 AS green,
  (h >= 170 OR h <= 10) AND s BETWEEN 50 AND 255 AND v BETWEEN 0 AND 255 AS red FROM hsv""")
def colour_mask(spark, folder):
    h, s, v = F.col("h"), F.col("s"), F.col("v")
    return colours(spark, folder).select(
        "l_orderkey", "image", "l_partkey", color.in_range(h, s, v, (28, 100, 50), (42, 255, 200)).alias("green"),
        color.in_range(h, s, v, (170, 50, 0), (10, 255, 255)).alias("red"),
    )


@query("hue_gate", f"""WITH {COLOURS}, g AS (SELECT * FROM hsv WHERE h BETWEEN 30 AND 90 AND s >= 40 AND v >= 40)
SELECT image, CAST(floor(quantile_cont(h, 0.05)) AS INTEGER) AS h_low, CAST(floor(quantile_cont(h, 0.95)) AS INTEGER) AS h_high,
  CAST(floor(quantile_cont(s, 0.05)) AS INTEGER) AS s_low, CAST(floor(quantile_cont(s, 0.95)) AS INTEGER) AS s_high,
  CAST(floor(quantile_cont(v, 0.05)) AS INTEGER) AS v_low, CAST(floor(quantile_cont(v, 0.95)) AS INTEGER) AS v_high FROM g GROUP BY 1 HAVING count(*) >= 50""")
def hue_gate(spark, folder):
    return luminance.hue_gate_range(colours(spark, folder), ["image"], 30, 90)


@query("colour_windows", f"""WITH {COLOURS} SELECT l_orderkey, image, l_partkey, greatest(0, h - 12) AS low_h, least(179, h + 12) AS high_h, greatest(0, s - 70) AS low_s, least(255, v + 70) AS high_v,
  CASE WHEN greatest(h, 90) - least(h, 90) > 90 THEN greatest(h, 90) ELSE least(h, 90) END AS pair_low, least(s, 128) AS pair_low_s, greatest(v, 30) AS pair_high_v FROM hsv""")
def colour_windows(spark, folder):
    here = F.struct("h", "s", "v")
    other = F.struct(F.lit(90).alias("h"), F.lit(128).alias("s"), F.lit(30).alias("v"))
    rows = colours(spark, folder).withColumn("w", color.window_around(here)).withColumn("p", color.range_of_two(here, other))
    return rows.select(
        "l_orderkey", "image", "l_partkey", F.col("w.lower.h").alias("low_h"), F.col("w.upper.h").alias("high_h"), F.col("w.lower.s").alias("low_s"),
        F.col("w.upper.v").alias("high_v"), F.col("p.lower.h").alias("pair_low"), F.col("p.lower.s").alias("pair_low_s"), F.col("p.upper.v").alias("pair_high_v"),
    )


@query("sample_colour", f"""WITH {COLOURS}, grid AS (SELECT image, CAST(l_partkey % 64 AS INTEGER) AS x, CAST(l_orderkey % 64 AS INTEGER) AS y, min(h) AS h, min(s) AS s, min(v) AS v FROM hsv GROUP BY 1, 2, 3),
picks AS (SELECT CAST(n.n AS INTEGER) AS pick, i.image, n.n * 2 AS px, n.n * 3 % 64 AS py FROM range(25) n(n), (SELECT DISTINCT image FROM hsv) i)
SELECT p.image, p.pick, CAST((CAST(round_even(round(atan2(avg(sin(h * pi() / 90)), avg(cos(h * pi() / 90))) * 90 / pi(), 9), 0) AS INTEGER) + 180) % 180 AS INTEGER) AS h,
  CAST(floor(quantile_cont(s, 0.5)) AS INTEGER) AS s, CAST(floor(quantile_cont(v, 0.5)) AS INTEGER) AS v
FROM picks p JOIN grid g ON g.image = p.image AND abs(g.x - p.px) <= 1 AND abs(g.y - p.py) <= 1 GROUP BY 1, 2""")
def sample_colour(spark, folder):
    grid = colours(spark, folder).groupBy(
        "image", (F.col("l_partkey") % 64).cast("int").alias("x"), (F.col("l_orderkey") % 64).cast("int").alias("y")
    ).agg(F.min("h").alias("h"), F.min("s").alias("s"), F.min("v").alias("v"))
    images = colours(spark, folder).select("image").distinct()
    key = F.col("pick")
    picks = images.select("image", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("pick")).select(
        "image", "pick", (key * 2).alias("x"), (key * 3 % 64).alias("y")
    )
    return luminance.sample_colour(grid, picks, ["image"])


PIX = """q AS (SELECT l_linenumber AS image, CAST(l_partkey % 64 AS INTEGER) AS x, CAST(l_orderkey % 64 AS INTEGER) AS y, CAST(max(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3),
px AS (SELECT image, x, y, v FROM q WHERE v > 45)"""


def quantity_pixels(spark, folder, low=0):
    return table(spark, folder, "lineitem").groupBy(
        F.col("l_linenumber").alias("image"), (F.col("l_partkey") % 64).cast("int").alias("x"), (F.col("l_orderkey") % 64).cast("int").alias("y")
    ).agg(F.max("l_quantity").alias("v")).where(F.col("v") > low)


RINGS = "(VALUES (0,-1,1),(1,-1,2),(1,0,4),(1,1,8),(0,1,16),(-1,1,32),(-1,0,64),(-1,-1,128)) r(dx, dy, bit)"


@query("neighbour_count", f"""WITH {PIX} SELECT p.image, p.x, p.y, CAST(count(n.x) AS INTEGER) AS degree, CAST(coalesce(sum(CASE WHEN n.x IS NOT NULL THEN r.bit END), 0) AS INTEGER) AS ring
FROM px p CROSS JOIN {RINGS} LEFT JOIN px n ON n.image = p.image AND n.x = p.x + r.dx AND n.y = p.y + r.dy GROUP BY 1, 2, 3""")
def neighbour_count(spark, folder):
    return pixels.neighbourhood(quantity_pixels(spark, folder, 45), ["image"])


@query("dilate", f"""WITH {PIX} SELECT DISTINCT image, CAST(x + i.i - 2 AS INTEGER) AS x, CAST(y + j.j - 2 AS INTEGER) AS y FROM px, range(5) i(i), range(5) j(j)
WHERE x + i.i - 2 BETWEEN 0 AND 63 AND y + j.j - 2 BETWEEN 0 AND 63""")
def dilate(spark, folder):
    return pixels.dilate(quantity_pixels(spark, folder, 45), ["image"], 2, 64, 64)


@query("erode", """WITH q AS (SELECT DISTINCT l_linenumber AS image, CAST(l_partkey % 64 AS INTEGER) AS x, CAST(l_orderkey % 64 AS INTEGER) AS y FROM lineitem WHERE l_quantity > 5)
SELECT p.image, p.x, p.y FROM q p JOIN q n ON n.image = p.image AND abs(n.x - p.x) <= 1 AND abs(n.y - p.y) <= 1
GROUP BY 1, 2, 3 HAVING count(*) = (least(63, p.x + 1) - greatest(0, p.x - 1) + 1) * (least(63, p.y + 1) - greatest(0, p.y - 1) + 1)""")
def erode(spark, folder):
    return pixels.erode(quantity_pixels(spark, folder, 5), ["image"], 1, 64, 64)


DEGREE = f"""deg AS (SELECT p.image, p.x, p.y, count(*) - 1 AS d FROM px p JOIN px n ON n.image = p.image AND abs(n.x - p.x) <= 1 AND abs(n.y - p.y) <= 1 GROUP BY 1, 2, 3)"""


@query("line_ends", f"WITH {PIX}, {DEGREE} SELECT image, x, y FROM deg WHERE d = 1")
def line_ends(spark, folder):
    return pixels.line_ends(quantity_pixels(spark, folder, 45), ["image"])


@query("branch_points", f"""WITH {PIX}, {DEGREE} SELECT DISTINCT image, CAST(x + i.i - 1 AS INTEGER) AS x, CAST(y + j.j - 1 AS INTEGER) AS y FROM deg, range(3) i(i), range(3) j(j) WHERE d >= 3""")
def branch_points(spark, folder):
    return pixels.branch_points(quantity_pixels(spark, folder, 45), ["image"])


@query("frame_difference", f"WITH {PIX} SELECT c.image, c.x, c.y, greatest(c.v - coalesce(p.v, 0), 0) AS gain FROM q c LEFT JOIN q p ON p.image = c.image - 1 AND p.x = c.x AND p.y = c.y")
def frame_difference(spark, folder):
    return pixels.frame_difference(quantity_pixels(spark, folder), [], "image", "v")


@query("exclusion_mask", f"""WITH {PIX} SELECT image, x, y FROM px p WHERE NOT (image <> 3 AND EXISTS (SELECT 1 FROM events e WHERE e.event_id % 7 + 1 = p.image AND e.user_id % 64 = p.x AND CAST(floor(e.value) AS INTEGER) % 64 = p.y))""")
def exclusion_mask(spark, folder):
    px = quantity_pixels(spark, folder, 45).withColumn("width", F.lit(64)).withColumn("height", F.lit(64))
    marks = table(spark, folder, "events").select((F.col("event_id") % 7 + 1).alias("image"), (F.col("user_id") % 64).cast("int").alias("x"), (F.floor("value").cast("int") % 64).alias("y")).distinct()
    # The mask of image 3 has another size, so it is ignored.
    marks = marks.withColumn("width", F.when(F.col("image") == 3, 65).otherwise(64)).withColumn("height", F.lit(64))
    return pixels.exclude(px, marks, ["image"]).select("image", "x", "y")


@query("clear_margins", f"WITH {PIX} SELECT image, x, y FROM px WHERE x BETWEEN 2 AND 61 AND y BETWEEN 0 AND 60")
def clear_margins(spark, folder):
    return pixels.clear_margins(quantity_pixels(spark, folder, 45), 64, 64, 0.0, 0.05, 0.03, 0.03).select("image", "x", "y")


@query("in_every_frame", f"WITH {PIX} SELECT x, y FROM q WHERE v > 10 GROUP BY 1, 2 HAVING count(DISTINCT image) = (SELECT count(DISTINCT image) FROM q)")
def in_every_frame(spark, folder):
    px = quantity_pixels(spark, folder).withColumn("one", F.lit(1))
    return pixels.in_every_frame(px.where("v > 10"), ["one", "x", "y"], "image", px, ["one"]).select("x", "y")


@query("mask_union", f"WITH {PIX} SELECT DISTINCT x, y FROM px")
def mask_union(spark, folder):
    return quantity_pixels(spark, folder, 45).select("x", "y").distinct()


@query("shared_history", f"WITH {PIX} SELECT image, x, y FROM px INTERSECT SELECT image + 1, x, y FROM px")
def shared_history(spark, folder):
    px = quantity_pixels(spark, folder, 45)
    return px.select("image", "x", "y").intersect(px.select((F.col("image") + 1).alias("image"), "x", "y"))


@query("lateral_pixels", f"WITH {PIX} SELECT image, x, y FROM q WHERE v > 30 EXCEPT SELECT image, x, y FROM px")
def lateral_pixels(spark, folder):
    keys = ["image", "x", "y"]
    px = quantity_pixels(spark, folder, 30)
    return px.join(px.where("v > 45"), keys, "left_anti").select(*keys)


@query("clear_above_stems", f"""WITH {PIX}, stems AS (SELECT n.n * 2 + 3 AS sx, n.n AS sy FROM range(25) n(n))
SELECT image, x, y FROM px WHERE NOT EXISTS (SELECT 1 FROM stems WHERE y < sy AND x >= greatest(sx - 5, 0) AND x < least(sx + 5, 63))""")
def clear_above_stems(spark, folder):
    px = quantity_pixels(spark, folder, 45)
    stems = px.select("image").distinct().select("image", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("y")).withColumn(
        "x", F.col("y") * 2 + 3
    )
    return pixels.clear_above_stems(px, stems, ["image"], F.lit(64)).select("image", "x", "y")


@query("erase_regions", f"WITH {PIX} SELECT image, x, y, CASE WHEN v > 45 THEN 0.0 ELSE v END AS v FROM q")
def erase_regions(spark, folder):
    px = quantity_pixels(spark, folder)
    return luminance.erase_regions(px, px.where("v > 45"), ["image"], ["v"]).withColumn("v", F.col("v").cast("double"))


@query("two_levels", f"WITH {PIX} SELECT image, x, y, v > 20 AS is_low, v > 30 AS is_high FROM q")
def two_levels(spark, folder):
    return luminance.levels(quantity_pixels(spark, folder), "v", 20, 30).drop("v")


LABELS = f"""{PIX}, ids AS (SELECT image, x, y, v, CAST(y AS BIGINT) * 4294967296 + x AS id FROM px),
adj AS (SELECT a.image, a.id AS a, b.id AS b FROM ids a JOIN ids b ON a.image = b.image AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
reach AS (SELECT image, id AS src, id AS cur FROM ids UNION SELECT r.image, r.src, adj.b FROM reach r JOIN adj ON r.image = adj.image AND r.cur = adj.a),
lab AS (SELECT image, src AS id, min(cur) AS label FROM reach GROUP BY 1, 2),
labelled AS (SELECT i.image, i.x, i.y, i.v, l.label FROM ids i JOIN lab l ON l.image = i.image AND l.id = i.id)"""


@query("components", f"WITH RECURSIVE {LABELS} SELECT image, x, y, label FROM labelled")
def component_labels(spark, folder):
    return components.label_pixels(quantity_pixels(spark, folder, 45), ["image"])


@query("component_stats", f"""WITH RECURSIVE {LABELS} SELECT image, label, count(*) AS area, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y,
  round(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2), 6) AS extent, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) > 2 * sqrt(4 * count(*) / pi()) AS elongated
FROM labelled GROUP BY 1, 2""")
def component_stats(spark, folder):
    labelled = components.label_pixels(quantity_pixels(spark, folder, 45), ["image"])
    return components.component_stats(labelled, ["image"]).withColumn("extent", F.round("extent", 6))


@query("two_level_keep", f"""WITH RECURSIVE {LABELS}, keep AS (SELECT image, label FROM labelled GROUP BY 1, 2 HAVING count(*) > 3 AND avg(CASE WHEN v > 49 THEN 1.0 ELSE 0.0 END) > 0.2)
SELECT image, x, y, label FROM labelled JOIN keep USING (image, label)""")
def two_level_keep(spark, folder):
    return components.two_level(quantity_pixels(spark, folder), ["image"], "v", 45, 49, min_pixels=3)


@query("drop_small", f"""WITH RECURSIVE {LABELS} SELECT image, x, y, label FROM labelled JOIN (SELECT image, label FROM labelled GROUP BY 1, 2 HAVING count(*) > 4) USING (image, label)""")
def drop_small(spark, folder):
    return components.drop_small(components.label_pixels(quantity_pixels(spark, folder, 45), ["image"]), ["image"], 4)


@query("new_growth", f"""WITH RECURSIVE q AS (SELECT l_linenumber AS image, CAST(l_partkey % 64 AS INTEGER) AS x, CAST(l_orderkey % 64 AS INTEGER) AS y, CAST(max(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3),
px AS (SELECT c.image, c.x, c.y, c.v FROM q c LEFT JOIN q p ON p.image = c.image - 1 AND p.x = c.x AND p.y = c.y WHERE greatest(c.v - coalesce(p.v, 0), 0) > 40),
{LABELS[len(PIX) + 2:]}, sizes AS (SELECT image, label, count(*) AS n FROM labelled GROUP BY 1, 2)
SELECT image, CAST(sum(n) AS BIGINT) AS new_area, count(*) FILTER (n > 3) AS new_parts FROM sizes GROUP BY 1""")
def new_growth(spark, folder):
    gain = pixels.frame_difference(quantity_pixels(spark, folder), [], "image", "v")
    return components.new_growth(gain, ["image"], "gain", 40, min_pixels=3)


@query("region_bounds", f"""WITH RECURSIVE {LABELS}, s AS (SELECT image, label, count(*) AS area, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM labelled GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY area DESC, label) AS rn FROM s)
SELECT image, label, area, min_x, max_x, min_y, max_y FROM b WHERE rn = 1""")
def region_bounds(spark, folder):
    stats = components.component_stats(components.label_pixels(quantity_pixels(spark, folder, 45), ["image"]), ["image"])
    return luminance.largest(stats, ["image"], F.col("area"), ["label", "area", "min_x", "max_x", "min_y", "max_y"])
