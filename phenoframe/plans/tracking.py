"""Bindings of the spatial, path and tracking operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoframe.operators import chains, components, evidence, growth, matching, registration, runs, skeleton, spatial, static
from phenoframe.operators.ordered import ordered_columns
from phenoframe.plans.imaging import LABELS, PIX, quantity_pixels
from phenoframe.plans.registry import query, table
from phenoframe.runtime import cut

CLOUD = """e AS (SELECT vec_id, label, embedding, unnest(range(len(embedding) // 2)) AS j FROM embeddings),
c AS (SELECT vec_id * 100 + j AS vec_id, vec_id % 2 AS frame, label, CAST(round(200 * embedding[2 * j + 1], 0) AS INTEGER) + 64 AS x, CAST(round(200 * embedding[2 * j + 2], 0) AS INTEGER) + 64 AS y FROM e),
a AS (SELECT vec_id, x, y FROM c WHERE frame = 0), b AS (SELECT DISTINCT x, y, label FROM c WHERE frame = 1)"""


def cloud(spark, folder):
    """Every two neighbouring values of a vector as a point."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1),
        lambda j: F.struct(j.alias("j"), F.get("embedding", j * 2).alias("a"), F.get("embedding", j * 2 + 1).alias("b")),
    )
    rows = table(spark, folder, "embeddings").select("vec_id", "label", F.explode(pairs).alias("p"))
    place = [(F.round(F.col(f"p.{c}") * 200) + 64).cast("int").alias(n) for c, n in (("a", "x"), ("b", "y"))]
    rows = rows.select((F.col("vec_id") * 100 + F.col("p.j")).alias("vec_id"), (F.col("vec_id") % 2).alias("frame"), "label", *place, F.lit(1).alias("k"))
    return rows.where("frame = 0"), rows.where("frame = 1")


@query("nearest_within", f"""WITH {CLOUD}, d AS (SELECT a.vec_id, b.x AS tx, b.y AS ty, b.label, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM a JOIN b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 16),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, ty, tx, label) AS rn FROM d)
SELECT a.vec_id, a.x, a.y, r.tx, r.ty, CAST(r.d2 AS BIGINT) AS d2, r.label FROM a LEFT JOIN r ON r.vec_id = a.vec_id AND rn = 1""")
def nearest_within(spark, folder):
    points, targets = cloud(spark, folder)
    out = spatial.nearest_within(points.drop("label"), targets, 4, ["k"], ["label"])
    return out.select("vec_id", "x", "y", "tx", "ty", "d2", "label")


@query("nearest_any", f"""WITH {CLOUD}, d AS (SELECT DISTINCT a.x, a.y, b.x AS tx, b.y AS ty, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM a, b),
r AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY d2, ty, tx) AS rn FROM d) SELECT x, y, tx, ty, CAST(d2 AS BIGINT) AS d2 FROM r WHERE rn = 1""")
def nearest_any(spark, folder):
    points, targets = cloud(spark, folder)
    out = spatial.nearest(points, targets, ["k"])
    return out.select("x", "y", F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), F.col("d2").cast("long").alias("d2"))


@query("minimum_gap", f"""WITH {CLOUD} SELECT p.label, round(min(sqrt((p.x - b.x) ** 2 + (p.y - b.y) ** 2)), 6) AS gap FROM (SELECT * FROM c WHERE frame = 0) p JOIN b ON p.label = b.label GROUP BY 1""")
def minimum_gap(spark, folder):
    points, targets = cloud(spark, folder)
    return spatial.minimum_gap(points, targets, ["label"]).withColumn("gap", F.round("gap", 6))


VOTE = """seg AS (SELECT image, y // 8 * 8 + x // 8 AS segment, x, y FROM px), hist AS (SELECT image - 1 AS image, x, y, x // 16 % 3 AS owner FROM px),
near AS (SELECT s.image, s.segment, s.x, s.y, h.owner, min((s.x - h.x) ** 2 + (s.y - h.y) ** 2) AS d2, any_value(s.n) AS n FROM (SELECT image, segment, x, y, count(*) AS n FROM seg GROUP BY 1, 2, 3, 4) s JOIN hist h ON s.image = h.image AND (s.x - h.x) ** 2 + (s.y - h.y) ** 2 <= 64 GROUP BY 1, 2, 3, 4, 5),
ex AS (SELECT *, count(*) FILTER (d2 <= 4) OVER w AS n2, count(*) FILTER (d2 <= 16) OVER w AS n4, count(*) OVER w AS n8 FROM near WINDOW w AS (PARTITION BY image, segment, x, y)),
v AS (SELECT image, segment, owner, coalesce(sum(n) FILTER (d2 <= 4 AND n2 = 1), 0) AS v2, coalesce(sum(n) FILTER (d2 <= 16 AND n4 = 1), 0) AS v4, coalesce(sum(n) FILTER (n8 = 1), 0) AS v8 FROM ex GROUP BY 1, 2, 3),
sz AS (SELECT image, segment, count(*) AS size FROM seg GROUP BY 1, 2),
bb AS (SELECT v.image, v.segment, any_value(size) AS size, max(v2) AS m2, arg_max(owner, v2 * 10 - owner) AS o2, sum(v2) AS t2, max(v4) AS m4, arg_max(owner, v4 * 10 - owner) AS o4, sum(v4) AS t4, max(v8) AS m8, arg_max(owner, v8 * 10 - owner) AS o8, sum(v8) AS t8 FROM v JOIN sz USING (image, segment) GROUP BY 1, 2)
SELECT image, CAST(segment AS BIGINT) AS segment, CAST(CASE WHEN m2 >= greatest(5, 0.2 * size) AND m2 >= 0.8 * t2 THEN o2 WHEN m4 >= greatest(10, 0.5 * size) AND m4 >= 0.8 * t4 THEN o4 ELSE o8 END AS BIGINT) AS owner,
  round(CASE WHEN m2 >= greatest(5, 0.2 * size) AND m2 >= 0.8 * t2 THEN m2 WHEN m4 >= greatest(10, 0.5 * size) AND m4 >= 0.8 * t4 THEN m4 ELSE m8 END / CAST(size AS DOUBLE), 6) AS share
FROM bb WHERE (m2 >= greatest(5, 0.2 * size) AND m2 >= 0.8 * t2) OR (m4 >= greatest(10, 0.5 * size) AND m4 >= 0.8 * t4) OR (m8 >= greatest(10, 0.5 * size) AND m8 >= 0.8 * t8)"""


@query("coverage_vote", f"WITH {PIX}, {VOTE}")
def coverage_vote(spark, folder):
    px = quantity_pixels(spark, folder, 45)
    segs = px.withColumn("segment", F.floor(F.col("y") / 8) * 8 + F.floor(F.col("x") / 8))
    history = px.withColumn("image", F.col("image") - 1).withColumn("owner", F.floor(F.col("x") / 16) % 3)
    return evidence.coverage_vote(segs, history, ["image"], "segment", "owner").select("image", "segment", "owner", F.round("share", 6).alias("share"))


SERIES = "ev AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, value FROM events)"


def event_series(spark, folder):
    rows = ordered_columns(table(spark, folder, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], number="_n")
    return rows.select("user_id", (F.col("_n") - 1).alias("pos"), "value")


@query("sustained_runs", f"""WITH {SERIES}, f AS (SELECT user_id, pos, pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) AS gap FROM ev WHERE value > 25),
g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM f)
SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n_rows, min(pos) AS first_pos, max(pos) AS last_pos FROM g GROUP BY 1, 2 HAVING count(*) >= 5""")
def sustained_runs(spark, folder):
    return runs.sustained_runs(event_series(spark, folder).where("value > 25"), ["user_id"], "pos")


@query("first_sustained", f"""WITH {SERIES}, f AS (SELECT user_id, pos, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS isl FROM ev WHERE value > 25),
g AS (SELECT user_id, isl, min(pos) AS p FROM f GROUP BY 1, 2 HAVING count(*) >= 4) SELECT user_id, min(p) AS position FROM g GROUP BY 1""")
def first_sustained(spark, folder):
    return runs.first_sustained(event_series(spark, folder).where("value > 25"), ["user_id"], "pos", 4)


@query("role_fragments", f"""WITH {SERIES}, c AS (SELECT *, value > 30 AS label, CASE WHEN (value > 30) IS DISTINCT FROM lag(value > 30) OVER w OR pos = 0 THEN 1 ELSE 0 END AS ch FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY pos) AS fragment FROM c)
SELECT user_id, CAST(fragment AS BIGINT) AS fragment, any_value(label) AS label, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_rows FROM g GROUP BY 1, 2""")
def role_fragments(spark, folder):
    return runs.fragments(event_series(spark, folder), ["user_id"], "pos", F.col("value") > 30)


@query("rolling_median", f"""WITH {SERIES}, e AS (SELECT user_id, max(pos) AS last FROM ev GROUP BY 1),
w AS (SELECT p.user_id, p.pos, v.value FROM ev p JOIN e USING (user_id), range(-3, 4) o(o) JOIN ev v ON v.user_id = p.user_id AND v.pos = least(e.last, greatest(0, p.pos + o.o)))
SELECT user_id, pos, round(quantile_cont(value, 0.5), 6) AS median FROM w GROUP BY 1, 2""")
def rolling_median(spark, folder):
    return runs.rolling_median(event_series(spark, folder), ["user_id"], "pos", "value", 3).select(
        "user_id", F.col("pos").cast("long").alias("pos"), F.round("median", 6).alias("median")
    )


@query("nearest_label", f"""WITH {SERIES}, s AS (SELECT *, pos * 2 + pos % 2 AS arc, CASE WHEN value > 60 THEN CAST(floor(value) AS BIGINT) END AS label FROM ev),
d AS (SELECT a.user_id, a.pos, b.label, row_number() OVER (PARTITION BY a.user_id, a.pos ORDER BY abs(a.arc - b.arc), b.arc) AS rn FROM s a JOIN s b ON a.user_id = b.user_id AND b.label IS NOT NULL)
SELECT s.user_id, s.pos, d.label AS nearest_label FROM s LEFT JOIN d ON d.user_id = s.user_id AND d.pos = s.pos AND rn = 1""")
def nearest_label(spark, folder):
    rows = event_series(spark, folder).withColumn("arc", F.col("pos") * 2 + F.col("pos") % 2).withColumn(
        "label", F.when(F.col("value") > 60, F.floor("value"))
    )
    return runs.nearest_label(rows, ["user_id"], "arc", "label").select("user_id", "pos", "nearest_label")


@query("arc_length", f"""WITH {SERIES}, s AS (SELECT *, sqrt(1 + (value - lag(value) OVER w) ** 2) AS st FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id, pos, round(sum(coalesce(st, 0.0)) OVER (PARTITION BY user_id ORDER BY pos), 5) AS arc FROM s""")
def arc_length(spark, folder):
    rows = growth.arc_length(event_series(spark, folder), ["user_id"], ["pos"], "pos", "value")
    return rows.select("user_id", "pos", F.round("arc", 5).alias("arc"))


@query("cumulative_offsets", f"""WITH {SERIES} SELECT user_id, pos, CAST(sum(CAST(floor(value) AS BIGINT) % 7 - 3) OVER w AS BIGINT) AS total_dx, CAST(sum(pos % 5 - 2) OVER w AS BIGINT) AS total_dy
FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos)""")
def cumulative_offsets(spark, folder):
    rows = event_series(spark, folder).withColumn("dx", F.floor("value") % 7 - 3).withColumn("dy", F.col("pos") % 5 - 2)
    return growth.cumulative_offsets(rows, ["user_id"], ["pos"], "dx", "dy").select("user_id", "pos", "total_dx", "total_dy")


VISIBLE = f"""WITH {SERIES}, p AS (SELECT user_id, pos, CAST(pos * 3 AS DOUBLE) AS x, CAST(floor(value) AS DOUBLE) AS y FROM ev), hid AS (SELECT DISTINCT user_id, CAST(pos * 3 AS INTEGER) AS mx, CAST(floor(value) AS INTEGER) AS my FROM ev WHERE value > 60 AND user_id % 3 <> 0),
n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
k AS (SELECT *, CASE WHEN nx IS NULL THEN 1 ELSE greatest(1, CAST(ceil(greatest(abs(nx - x), abs(ny - y))) AS INTEGER)) END AS cnt FROM n),
s AS (SELECT user_id, pos, st.st AS step, x + coalesce((nx - x) * (st.st / CAST(cnt AS DOUBLE)), 0.0) AS x, y + coalesce((ny - y) * (st.st / CAST(cnt AS DOUBLE)), 0.0) AS y FROM (SELECT *, unnest(range(0, cnt)) AS st FROM k) st),
h AS (SELECT s.*, hid.mx IS NOT NULL AS hidden FROM s LEFT JOIN hid ON hid.user_id = s.user_id AND hid.mx = round_even(s.x, 0) AND hid.my = round_even(s.y, 0)),
any_h AS (SELECT user_id, bool_or(hidden) AS touched FROM h GROUP BY 1),
r AS (SELECT h.*, CASE WHEN NOT hidden AND coalesce(lag(hidden) OVER (PARTITION BY user_id ORDER BY pos, step), true) THEN 1 ELSE 0 END AS st FROM h),
g AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY pos, step) AS piece FROM r)
SELECT user_id, CAST(piece AS BIGINT) AS piece, count(*) AS n_points, CAST((sum(CAST(floor(x * 1000000 + 0.5) AS BIGINT)) + 500) // 1000 AS DOUBLE) / 1000 AS sum_x FROM g JOIN any_h USING (user_id) WHERE touched AND NOT hidden GROUP BY 1, 2
UNION ALL SELECT user_id, 1, count(*), CAST((sum(CAST(floor(x * 1000000 + 0.5) AS BIGINT)) + 500) // 1000 AS DOUBLE) / 1000 FROM p JOIN any_h USING (user_id) WHERE NOT touched GROUP BY 1"""


@query("visible_runs", VISIBLE)
def visible_runs(spark, folder):
    points = cut(event_series(spark, folder), "series").select(
        "user_id", "pos", (F.col("pos") * 3).cast("double").alias("x"), F.floor("value").cast("double").alias("y"), "value"
    )
    mask = points.where("value > 60 and user_id % 3 <> 0").select("user_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    pieces = runs.visible_runs(points.drop("value"), mask, ["user_id"], "pos", ["user_id"])
    return piece_sums(pieces)


def piece_sums(pieces):
    """Sums in whole millionths, rounded half up: a sum of doubles would depend on the order of the rows."""
    millionths = F.sum(F.floor(F.col("x") * 1000000 + 0.5))
    return pieces.groupBy("user_id", "piece").agg(F.count(F.lit(1)).alias("n_points"), millionths.alias("_s")).select(
        "user_id", "piece", "n_points", (F.expr("(_s + 500) div 1000").cast("double") / 1000).alias("sum_x"))


ENDS = """kid AS (SELECT p_partkey AS child, p_partkey % 7 AS img, CAST(p_partkey * 13 % 400 AS INTEGER) AS x, CAST(p_partkey * 29 % 300 AS INTEGER) AS y, CAST(p_size * 7 AS DOUBLE) AS angle FROM part WHERE p_partkey % 2 = 0),
old AS (SELECT p_partkey AS parent, p_partkey % 7 AS img, CAST(p_partkey * 17 % 400 AS INTEGER) AS x, CAST(p_partkey * 31 % 300 AS INTEGER) AS y, CAST(p_size * 6 AS DOUBLE) AS angle, p_partkey % 10 = 1 AS stem FROM part WHERE p_partkey % 2 = 1),
pr AS (SELECT k.img, child, parent, sqrt((k.x - o.x) ** 2 + (k.y - o.y) ** 2) AS dist, (k.angle + 180) % 360 AS ua, o.angle AS la, degrees(atan2(o.y - k.y, o.x - k.x)) + 180 AS pa, stem, abs(k.x - o.x) AS dx, abs(k.y - o.y) AS dy
  FROM kid k JOIN old o ON k.img = o.img AND o.y <= k.y),
ok AS (SELECT * FROM pr WHERE CASE WHEN stem THEN dx <= 20 AND dy <= 26 ELSE dist <= 20 END),
cost AS (SELECT img, child, parent, dist + abs(((ua - la + 180) % 360 + 360) % 360 - 180) * 40 / 180 / 4 + abs(((pa - ua + 180) % 360 + 360) % 360 - 180) * 40 / 180 / 2 + abs(((pa - la + 180) % 360 + 360) % 360 - 180) * 40 / 180 / 2 AS cost FROM ok)"""


def part_ends(spark, folder):
    key = F.col("p_partkey")
    place = lambda a, b: [(key * a % 400).cast("int").alias("x"), (key * b % 300).cast("int").alias("y")]
    rows = table(spark, folder, "part")
    kids = rows.where("p_partkey % 2 = 0").select(key.alias("child"), (key % 7).alias("img"), *place(13, 29), (F.col("p_size") * 7).cast("double").alias("angle"))
    olds = rows.where("p_partkey % 2 = 1").select(key.alias("parent"), (key % 7).alias("img"), *place(17, 31), (F.col("p_size") * 6).cast("double").alias("angle"), (key % 10 == 1).alias("is_stem"))
    return kids, olds


@query("link_candidates", f"WITH {ENDS} SELECT img, child, parent, round(cost, 6) AS cost FROM cost")
def link_candidates(spark, folder):
    return matching.link_candidates(*part_ends(spark, folder), ["img"], 40).withColumn("cost", F.round("cost", 6))


@query("least_cost_parent", f"WITH {ENDS} SELECT img, child, arg_min(parent, (round(cost, 6), parent)) AS parent, round(min(cost), 6) AS cost FROM cost GROUP BY 1, 2")
def least_cost_parent(spark, folder):
    """Costs that agree to a millionth are equal; the smaller parent is taken then."""
    return matching.least_cost(link_candidates(spark, folder), ["img"])


@query("mutual_nearest", f"""WITH {ENDS}, c AS (SELECT img, child, parent, CAST(round(cost, 0) AS BIGINT) AS d FROM cost),
k AS (SELECT img, child, d, min(parent) AS parent, count(*) AS n FROM c WHERE (img, child, d) IN (SELECT (img, child, min(d)) FROM c GROUP BY img, child) GROUP BY 1, 2, 3),
p AS (SELECT img, parent, d, min(child) AS child, count(*) AS n FROM c WHERE (img, parent, d) IN (SELECT (img, parent, min(d)) FROM c GROUP BY img, parent) GROUP BY 1, 2, 3)
SELECT k.img, k.child, k.parent, k.d FROM k JOIN p ON k.img = p.img AND k.child = p.child AND k.parent = p.parent WHERE k.n = 1 AND p.n = 1""")
def mutual_nearest(spark, folder):
    pairs = matching.link_candidates(*part_ends(spark, folder), ["img"], 40).withColumn("d", F.round("cost").cast("long"))
    return matching.mutual_nearest(pairs, ["img"], "child", "parent", "d").select("img", "child", "parent", "d")


@query("offset_vote", f"""WITH {PIX}, e AS (SELECT image AS f, x, y FROM px), t AS (SELECT image + 1 AS f, x, y FROM px),
dens AS (SELECT f, count(*) / 4096.0 AS d, count(*) AS n FROM t GROUP BY 1),
o AS (SELECT CAST(dx.dx - 16 AS INTEGER) AS dx, CAST(dy.dy - 16 AS INTEGER) AS dy FROM range(33) dx(dx), range(33) dy(dy)),
w AS (SELECT e.f, o.dx, o.dy, count(*) AS win FROM e, o WHERE e.x + o.dx BETWEEN 0 AND 63 AND e.y + o.dy BETWEEN 0 AND 63 GROUP BY 1, 2, 3),
ov AS (SELECT e.f, CAST(t.x - e.x AS INTEGER) AS dx, CAST(t.y - e.y AS INTEGER) AS dy, count(*) AS ov FROM e JOIN t ON e.f = t.f AND abs(t.x - e.x) <= 16 AND abs(t.y - e.y) <= 16 GROUP BY 1, 2, 3),
s AS (SELECT w.f, w.dx, w.dy, coalesce(ov, 0) * 4096 - n * win AS sc FROM w JOIN dens ON w.f = dens.f LEFT JOIN ov ON ov.f = w.f AND ov.dx = w.dx AND ov.dy = w.dy),
r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY sc DESC, dy DESC, dx DESC) AS rn FROM s)
SELECT f AS image, dx, dy FROM r WHERE rn = 1""")
def offset_vote(spark, folder):
    return registration.pair_offsets(quantity_pixels(spark, folder, 45), [], "image", 64, 64)


@query("apply_offsets", f"""WITH {PIX} SELECT image, CAST(x + image - 4 AS INTEGER) AS x, CAST(y - image + 2 AS INTEGER) AS y FROM px WHERE x + image - 4 BETWEEN 0 AND 63 AND y - image + 2 BETWEEN 0 AND 63""")
def apply_offsets(spark, folder):
    px = quantity_pixels(spark, folder, 45)
    offsets = px.select("image").distinct().select("image", (F.col("image") - 4).alias("dx"), (2 - F.col("image")).alias("dy"))
    return registration.shift(px, offsets, ["image"], F.lit(64), F.lit(64)).select("image", "x", "y")


CONTACTS = f"""{PIX}, adj AS (SELECT a.image, a.x, a.y, b.x AS tx, b.y AS ty FROM px a JOIN px b ON a.image = b.image AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y)
  WHERE a.x = b.x OR a.y = b.y OR NOT EXISTS (SELECT 1 FROM px c WHERE c.image = a.image AND ((c.x = b.x AND c.y = a.y) OR (c.x = a.x AND c.y = b.y)))),
deg AS (SELECT image, x, y, count(*) AS d FROM adj GROUP BY 1, 2, 3)"""


@query("polyline_edges", f"WITH {CONTACTS} SELECT image, CAST(count(*) / 2 AS BIGINT) AS n_edges FROM adj GROUP BY 1")
def polyline_edges(spark, folder):
    points = chains.trace_polylines(quantity_pixels(spark, folder, 45), ["image"])
    return points.groupBy("image").agg(F.count_if(F.col("pos") > 0).alias("n_edges"))


@query("polylines")
def polylines(spark, folder):
    points = chains.trace_polylines(quantity_pixels(spark, folder, 45), ["image"])
    return points.groupBy("image", "path_a", "path_b").agg(
        F.count(F.lit(1)).alias("n_points"), F.max_by(F.struct("x", "y"), "pos").alias("_end")
    ).select("image", "path_a", "path_b", "n_points", F.col("_end.x").alias("end_x"), F.col("_end.y").alias("end_y"))


@query("segment_ends")
def segment_ends(spark, folder):
    points = chains.trace_polylines(quantity_pixels(spark, folder, 45), ["image"])
    ends = chains.segment_ends(points, ["image"])
    return ends.select(
        "image", "path_a", "path_b", "n_steps", F.col("upper.x").alias("upper_x"), F.col("upper.y").alias("upper_y"),
        F.round("upper.angle", 6).alias("upper_angle"), F.col("lower.x").alias("lower_x"), F.col("lower.y").alias("lower_y"),
        F.round("lower.angle", 6).alias("lower_angle"),
    )


@query("split_segments", f"""WITH RECURSIVE {PIX.replace("px AS", "full_px AS")}, dg AS (SELECT p.image, p.x, p.y, count(*) - 1 AS d FROM full_px p JOIN full_px n ON n.image = p.image AND abs(n.x - p.x) <= 1 AND abs(n.y - p.y) <= 1 GROUP BY 1, 2, 3),
px AS (SELECT image, x, y, v FROM full_px p WHERE NOT EXISTS (SELECT 1 FROM dg WHERE dg.image = p.image AND d >= 3 AND abs(dg.x - p.x) <= 1 AND abs(dg.y - p.y) <= 1)),
{LABELS[len(PIX) + 2:]} SELECT image, x, y, label FROM labelled JOIN (SELECT image, label FROM labelled GROUP BY 1, 2 HAVING count(*) > 2) USING (image, label)""")
def split_segments(spark, folder):
    from phenoframe.operators import pixels

    px = quantity_pixels(spark, folder, 45).select("image", "x", "y")
    pieces = px.join(pixels.branch_points(px, ["image"]), ["image", "x", "y"], "left_anti")
    return components.drop_small(components.label_pixels(pieces, ["image"]), ["image"], 2)


@query("thinning")
def thinning(spark, folder):
    return skeleton.thin(quantity_pixels(spark, folder, 20), ["image"])


@query("local_width", f"""WITH {PIX}, fg AS (SELECT image, x, y FROM q WHERE v > 20), gap AS (SELECT i.image, CAST(x.x AS INTEGER) AS x, CAST(y.y AS INTEGER) AS y FROM (SELECT DISTINCT image FROM fg) i, range(64) x(x), range(64) y(y) EXCEPT SELECT image, x, y FROM fg)
SELECT f.image, f.x, f.y, round(2 * sqrt(min((f.x - g.x) ** 2 + (f.y - g.y) ** 2)), 6) AS width FROM fg f JOIN gap g ON g.image = f.image AND abs(f.x - g.x) <= 12 AND abs(f.y - g.y) <= 12 GROUP BY 1, 2, 3""")
def local_width(spark, folder):
    fg = quantity_pixels(spark, folder, 20).select("image", "x", "y")
    return skeleton.widths(fg, fg, ["image"], 64, 64).withColumn("width", F.round("width", 6))


@query("static_objects")
def static_objects(spark, folder):
    px = quantity_pixels(spark, folder, 47).select((F.col("image") % 2).alias("grp"), F.floor(F.col("image") / 2).alias("frame"), "x", "y")
    origins = spark.createDataFrame([(0, 30, 10), (1, 30, 10)], "grp int, x int, y int")
    frames = px.select("grp", "frame").distinct().withColumn("usable", F.lit(True))
    return static.drop_static(px, origins, frames, ["grp"], "frame", 64)


@query("gap_gate")
def gap_gate(spark, folder):
    px = components.label_pixels(quantity_pixels(spark, folder, 47), ["image"])
    labelled = cut(px, "labels")
    below = labelled.select("image", "x", (F.col("y") + 3).alias("y"), F.col("label").alias("parent_label"))
    pairs = labelled.join(below, ["image", "x", "y"]).select("image", F.col("label").alias("child_label"), "parent_label").distinct()
    return evidence.gap_gate(pairs, labelled, ["image"])
