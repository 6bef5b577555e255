"""Bindings of the override, polyline and correction operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoframe.functions import geometry as fg
from phenoframe.operators import edits, growth, measure, overlay, runs
from phenoframe.plans.registry import query, table

LINES = """pts AS (SELECT conv_id, turn, CAST(turn * 10 AS DOUBLE) AS x, CAST(length(text) % 500 AS DOUBLE) AS y FROM conversations),
steps AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM pts WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
lens AS (SELECT conv_id, sum(CASE WHEN nx IS NULL THEN 0.0 ELSE sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) END) AS length,
  max(y) - min(y) AS depth, count(*) AS n_points, arg_min(x, turn) AS bx, arg_min(y, turn) AS by_ FROM steps GROUP BY 1),
axes AS (SELECT *, conv_id // 12 AS image, conv_id % 3 AS plant, conv_id % 4 <> 0 AND conv_id % 12 <> 0 AS is_lateral FROM lens)"""


def line_points(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", (F.col("turn") * 10).cast("double").alias("x"), (F.length("text") % 500).cast("double").alias("y")
    )


def line_axes(spark, folder):
    """One axis per conversation, measured from point rows without building arrays."""
    points = line_points(spark, folder)
    lengths = runs.path_length(points, ["conv_id"], "turn", "x", "y")
    bases = points.where("turn = 0").select("conv_id", F.col("x").alias("base_x"), F.col("y").alias("base_y"))
    lateral = (F.col("conv_id") % 4 != 0) & (F.col("conv_id") % 12 != 0)
    return lengths.join(bases, "conv_id", "left").select(
        "*", F.floor(F.col("conv_id") / 12).alias("image"), (F.col("conv_id") % 3).alias("plant"),
        F.when(lateral, F.col("conv_id") - 1).alias("parent"),
    )


@query("polyline_length", f"WITH {LINES} SELECT conv_id, round(length, 6) AS length, depth, n_points FROM lens")
def polyline_length(spark, folder):
    rows = runs.path_length(line_points(spark, folder), ["conv_id"], "turn", "x", "y")
    return rows.select("conv_id", F.round("length", 6).alias("length"), "depth", "n_points")


@query("polyline_array_length", """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings)
SELECT vec_id, round(list_sum([sqrt((v[k + 3] - v[k]) ** 2 + (v[k + 4] - v[k + 1]) ** 2 + (v[k + 5] - v[k + 2]) ** 2) FOR k IN range(1, len(v) // 3 * 3 - 2, 3)]), 6) AS length,
  round(list_max([v[k] FOR k IN range(2, len(v) // 3 * 3 + 1, 3)]) - list_min([v[k] FOR k IN range(2, len(v) // 3 * 3 + 1, 3)]), 6) AS depth FROM e""")
def polyline_array_length(spark, folder):
    line = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("embedding") / 3).cast("int") - 1),
        lambda i: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: F.get("embedding", i * 3 + j).cast("double")),
    )
    rows = measure.axis_geometry(table(spark, folder, "embeddings").select("vec_id", line.alias("points")))
    return rows.select("vec_id", F.round("length", 6).alias("length"), F.round("depth", 6).alias("depth"))


@query("override_measures", f"""WITH {LINES}, m AS (SELECT image, plant, arg_max(conv_id, length * 1e6 - conv_id) FILTER (NOT is_lateral) AS main FROM axes GROUP BY 1, 2),
t AS (SELECT image, plant, count(*) AS plant_root_count, round(sum(length), 6) AS plant_total_length FROM axes GROUP BY 1, 2)
SELECT t.image, t.plant, plant_root_count, plant_total_length, coalesce(a.depth, 0.0) AS plant_main_root_depth,
  round(coalesce(a.length, 0.0), 6) AS plant_main_root_length, a.bx AS plant_center_x, a.by_ AS plant_center_y
FROM t JOIN m ON t.image = m.image AND t.plant = m.plant LEFT JOIN axes a ON a.conv_id = m.main""")
def override_measures(spark, folder):
    out = measure.override_measures(line_axes(spark, folder), ["image", "plant"], "conv_id", "parent")
    return out.withColumn("plant_total_length", F.round("plant_total_length", 6)).withColumn(
        "plant_main_root_length", F.round("plant_main_root_length", 6)
    )


@query("plant_totals", f"""WITH {LINES} SELECT image, plant, count(*) FILTER (NOT is_lateral) AS n_primary, count(*) FILTER (is_lateral) AS n_lateral,
  round(sum(length), 6) AS total_length, round(coalesce(sum(length) FILTER (is_lateral), 0.0), 6) AS lateral_length,
  max(depth) FILTER (NOT is_lateral) AS main_depth FROM axes GROUP BY 1, 2""")
def plant_totals(spark, folder):
    out = measure.plant_totals(line_axes(spark, folder), ["image", "plant"], "parent")
    return out.withColumn("total_length", F.round("total_length", 6)).withColumn("lateral_length", F.round("lateral_length", 6))


@query("document_report", f"""WITH {LINES} SELECT image, count(DISTINCT plant) AS n_plants, count(*) AS n_axes, CAST(sum(n_points) AS BIGINT) AS n_points,
  round(sum(length), 6) AS total_length, round(max(length), 6) AS longest FROM axes GROUP BY 1""")
def document_report(spark, folder):
    out = measure.document_report(line_axes(spark, folder).withColumnRenamed("plant", "plant_index"), ["image"])
    return out.withColumn("total_length", F.round("total_length", 6)).withColumn("longest", F.round("longest", 6))


@query("plant_slots", """WITH p AS (SELECT c_nationkey AS doc, c_custkey AS pos,
    CASE WHEN c_nationkey % 3 = 0 THEN CAST(row_number() OVER w AS VARCHAR) WHEN c_nationkey % 3 = 1 THEN CAST(c_custkey AS VARCHAR) ELSE c_mktsegment END AS pid,
    row_number() OVER w AS rn FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey))
SELECT doc, pos, pid, CAST(CASE WHEN doc % 3 = 0 THEN rn ELSE pos + 1 END AS INTEGER) AS slot, doc % 3 = 0 AS numeric_slots FROM p""")
def plant_slots(spark, folder):
    from phenoframe.operators.ordered import ordered_columns

    rows = table(spark, folder, "customer").select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("pos"), "c_mktsegment")
    rows = ordered_columns(rows, ["doc"], ["pos"], number="rn")
    pid = (
        F.when(F.col("doc") % 3 == 0, F.col("rn").cast("string"))
        .when(F.col("doc") % 3 == 1, F.col("pos").cast("string")).otherwise(F.col("c_mktsegment"))
    )
    return measure.plant_slots(rows.withColumn("pid", pid), ["doc"], "pos", "pid")


VERSIONS = """v AS (SELECT user_id, event_id AS version, event_type IN ('click', 'view') AS manual, event_type = 'error' AS deleted,
  CASE WHEN event_type <> 'error' THEN props END AS source FROM events)"""


def override_versions(spark, folder):
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        "user_id", F.col("event_id").alias("version"), kind.isin("click", "view").alias("manual"),
        (kind == "error").alias("deleted"), F.when(kind != "error", F.col("props")).alias("source"),
    )


@query("latest_overrides", f"""WITH {VERSIONS} SELECT v.* FROM v JOIN (SELECT user_id, max(version) AS version FROM v GROUP BY 1) n
ON v.user_id = n.user_id AND v.version = n.version WHERE NOT deleted""")
def latest_overrides(spark, folder):
    return overlay.latest_versions(override_versions(spark, folder), "user_id", "version")


@query("undo_manual", f"""WITH {VERSIONS}, now AS (SELECT user_id, max(version) AS version FROM v GROUP BY 1),
imp AS (SELECT user_id, max(version) AS version FROM v WHERE NOT manual GROUP BY 1)
SELECT n.user_id, CASE WHEN i2.source IS NOT NULL THEN i2.source END AS source, false AS manual, i2.source IS NULL AS deleted, n.version + 1000000 AS version
FROM now n JOIN v ON v.user_id = n.user_id AND v.version = n.version LEFT JOIN imp ON imp.user_id = n.user_id
LEFT JOIN v i2 ON i2.user_id = imp.user_id AND i2.version = imp.version WHERE v.manual""")
def undo_manual(spark, folder):
    rows = override_versions(spark, folder)
    newest = rows.groupBy("user_id").agg((F.max("version") + 1000000).alias("_next"))
    undone = overlay.undo_manual(rows, "user_id", "version", F.lit(0).cast("long"))
    return undone.join(newest, "user_id").withColumn("version", F.col("_next")).drop("_next")


@query("override_gate", """WITH d AS (SELECT page_id AS image, CAST(40 + page_id % 60 AS INTEGER) AS width, CAST(60 + page_id % 70 AS INTEGER) AS height, page_id % 9 AS n_plants FROM pages),
p AS (SELECT page_id AS image, [[CAST(length(url) AS DOUBLE), CAST(page_id % 50 AS DOUBLE)], CASE WHEN page_id % 11 = 0 THEN [1.0, 2.0, 3.0] ELSE [CAST(page_id % 70 AS DOUBLE), 5.0] END] AS pts, page_id % 13 = 0 AS empty FROM pages)
SELECT d.image, CASE WHEN n_plants < 1 THEN 'no plant' WHEN empty THEN 'axis without points' WHEN len(pts[2]) <> 2 THEN 'not two-dimensional'
  WHEN pts[1][1] >= width OR pts[1][2] >= height OR pts[2][1] >= width OR pts[2][2] >= height THEN 'outside the image' END AS reason
FROM d JOIN p ON d.image = p.image""")
def override_gate(spark, folder):
    pages = table(spark, folder, "pages")
    key = F.col("page_id")
    images = pages.select(
        key.alias("image"), (40 + key % 60).alias("width"), (60 + key % 70).alias("height"), (key % 9).alias("n_plants")
    )
    second = F.when(key % 11 == 0, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).otherwise(F.array((key % 70).cast("double"), F.lit(5.0)))
    line = F.array(F.array(F.length("url").cast("double"), (key % 50).cast("double")), second)
    points = F.when(key % 13 == 0, F.array().cast("array<array<double>>")).otherwise(line)
    return overlay.override_gate(pages.select(key.alias("image"), points.alias("points")), images, "image")


FRAMES = """tracked AS (SELECT o_custkey AS grp, o_orderkey AS image, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS frame,
  o_orderdate AS date, o_totalprice AS v FROM orders)"""


def frames(spark, folder):
    from phenoframe.operators.ordered import ordered_columns

    rows = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("image"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("date"), F.col("o_totalprice").alias("v"),
    )
    return ordered_columns(rows, ["grp"], ["date", "image"], number="frame")


@query("override_merge", """SELECT o_orderkey AS image, o_custkey AS grp, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS v,
  CASE WHEN o_orderkey % 5 = 0 THEN 'override' ELSE 'tracked' END AS root_source FROM orders""")
def override_merge(spark, folder):
    tracked = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("image"), F.col("o_custkey").alias("grp"), F.col("o_totalprice").alias("v")
    )
    rows = tracked.where("image % 5 = 0").withColumn("v", F.col("v") * 2)
    return overlay.replace_frames(tracked, rows, "image")


@query("override_sessions", f"""WITH {FRAMES} SELECT grp, image, frame,
  CAST(sum(CASE WHEN image % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY frame) AS BIGINT) AS session FROM tracked""")
def override_sessions(spark, folder):
    rows = growth.override_sessions(frames(spark, folder), ["grp"], ["frame"], F.col("image") % 5 == 0)
    return rows.select("grp", "image", "frame", "session")


@query("previous_by_slot", f"""WITH {FRAMES}, s AS (SELECT grp, frame, image % 2 AS plant, v FROM tracked)
SELECT a.grp, a.frame, a.plant, a.v, b.v AS prev_v FROM s a LEFT JOIN s b ON a.grp = b.grp AND a.plant = b.plant AND a.frame = b.frame + 1""")
def previous_by_slot(spark, folder):
    rows = frames(spark, folder).select("grp", "frame", (F.col("image") % 2).alias("plant"), "v")
    return overlay.previous_by_slot(rows, "grp", "frame", "plant", ["v"])


PLANTS = """rowset AS (SELECT grp, frame, date, v, image, k.plant, CASE WHEN image % 4 = 0 THEN 'a' ELSE 'p' || (k.plant + image % 2) END AS source
  FROM tracked, (VALUES (1), (2)) k(plant))"""


def plant_frames(spark, folder):
    image = F.col("image")
    return frames(spark, folder).withColumn("plant", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
        "source", F.when(image % 4 == 0, F.lit("a")).otherwise(F.concat(F.lit("p"), (F.col("plant") + image % 2).cast("string")))
    )


@query("previous_by_source", f"""WITH {FRAMES}, {PLANTS}, uniq AS (SELECT grp, frame, source, any_value(v * plant) AS v FROM rowset GROUP BY 1, 2, 3 HAVING count(*) = 1)
SELECT r.grp, r.frame, r.plant, r.source, round(b.v, 4) AS prev_v FROM rowset r
LEFT JOIN uniq u ON u.grp = r.grp AND u.frame = r.frame AND u.source = r.source
LEFT JOIN uniq b ON b.grp = u.grp AND b.frame = u.frame - 1 AND b.source = u.source""")
def previous_by_source(spark, folder):
    rows = plant_frames(spark, folder).select("grp", "frame", "plant", "source", (F.col("v") * F.col("plant")).alias("v"))
    out = overlay.previous_by_source(rows, "grp", "frame", "source", ["v"])
    return out.select("grp", "frame", "plant", "source", F.round("prev_v", 4).alias("prev_v"))


@query("refresh_rates", f"""WITH {FRAMES}, {PLANTS}, base AS (SELECT *, v * plant AS len, image % 5 = 0 AS ov, (image % 5 = 0 AND image % 2 = 0) = false AS num FROM rowset),
uniq AS (SELECT grp, frame, source, any_value(len) AS len FROM base GROUP BY 1, 2, 3 HAVING count(*) = 1),
j AS (SELECT a.*, b.len AS plen, f.date AS pdate, f.ov AS pov, f.num AS pnum, ub.len AS idlen FROM base a
  LEFT JOIN base b ON b.grp = a.grp AND b.frame = a.frame - 1 AND b.plant = a.plant
  LEFT JOIN (SELECT DISTINCT grp, frame, date, ov, num FROM base) f ON f.grp = a.grp AND f.frame = a.frame - 1
  LEFT JOIN uniq ua ON ua.grp = a.grp AND ua.frame = a.frame AND ua.source = a.source
  LEFT JOIN uniq ub ON ub.grp = ua.grp AND ub.frame = ua.frame - 1 AND ub.source = ua.source),
p AS (SELECT *, CASE WHEN num AND coalesce(pnum, true) THEN plen WHEN ov AND coalesce(pov, false) THEN idlen END AS prev,
  ov OR coalesce(pov, false) AS touched, date_sub('day', pdate, date) AS days FROM j)
SELECT grp, frame, plant, round(CASE WHEN NOT touched THEN 7.0 WHEN len > 0 AND prev > 0 AND days > 0 THEN (ln(len) - ln(prev)) / days END, 6) AS len_RGR,
  CASE WHEN NOT touched THEN image END AS image_new_area FROM p""")
def refresh_rates(spark, folder):
    image = F.col("image")
    rows = plant_frames(spark, folder).select(
        "grp", "frame", "date", "plant", "source", (F.col("v") * F.col("plant")).alias("len"),
        F.lit(7.0).alias("len_RGR"), image.alias("image_new_area"), (image % 5 == 0).alias("is_override"),
        (~((image % 5 == 0) & (image % 2 == 0))).alias("numeric_slots"),
    )
    out = overlay.refresh_rates(rows, "grp", "frame", "date", "plant", "source", ["len"])
    return out.select("grp", "frame", "plant", F.round("len_RGR", 6).alias("len_RGR"), "image_new_area")


@query("reassign_axes", """WITH RECURSIVE axes AS (
  SELECT n_regionkey AS doc, CAST(n_nationkey AS BIGINT) AS idx, CAST(NULL AS BIGINT) AS parent, CAST(n_nationkey % 2 AS BIGINT) AS plant FROM nation
  UNION ALL SELECT n_regionkey, 100 + c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN 100 + c_custkey - 3 * 25 ELSE c_nationkey END AS BIGINT), c_nationkey % 2 FROM customer JOIN nation ON c_nationkey = n_nationkey),
fixed AS (SELECT a.doc, a.idx, CASE WHEN b.idx IS NOT NULL THEN a.parent END AS parent, coalesce(b.plant, a.plant) AS plant FROM axes a LEFT JOIN axes b ON a.doc = b.doc AND a.parent = b.idx),
edited AS (SELECT doc, idx, parent, CASE WHEN idx % 7 = 3 THEN 1 - plant ELSE plant END AS plant FROM fixed WHERE idx % 11 <> 5),
linked AS (SELECT e.doc, e.idx, CASE WHEN p.plant = e.plant THEN e.parent END AS parent, e.plant FROM edited e LEFT JOIN edited p ON e.doc = p.doc AND e.parent = p.idx),
walk AS (SELECT doc, idx, parent, plant, [idx] AS path FROM linked WHERE parent IS NULL
  UNION ALL SELECT l.doc, l.idx, l.parent, l.plant, list_append(w.path, l.idx) FROM linked l JOIN walk w ON l.doc = w.doc AND l.parent = w.idx),
num AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY plant, path) - 1 AS new_index FROM walk)
SELECT n.doc, n.new_index AS idx, p.new_index AS parent, n.plant, n.idx AS source_index FROM num n LEFT JOIN num p ON n.doc = p.doc AND n.parent = p.idx""")
def reassign_axes(spark, folder):
    nation = table(spark, folder, "nation")
    homes = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("doc"))
    key, home = F.col("c_custkey"), F.col("c_nationkey")
    upper = nation.select(
        F.col("n_regionkey").alias("doc"), F.col("n_nationkey").cast("long").alias("idx"),
        F.lit(None).cast("long").alias("parent"), (F.col("n_nationkey") % 2).cast("long").alias("plant"),
    )
    lower = table(spark, folder, "customer").join(F.broadcast(homes), "c_nationkey").select(
        "doc", (100 + key).alias("idx"),
        F.when(key % 3 == 0, 100 + key - 75).otherwise(home).cast("long").alias("parent"), (home % 2).cast("long").alias("plant"),
    )
    axes = upper.unionByName(lower)
    known = axes.select("doc", F.col("idx").alias("parent"), F.col("plant").alias("_p"))
    axes = axes.join(known, ["doc", "parent"], "left").select(
        "doc", "idx", F.when(F.col("_p").isNotNull(), F.col("parent")).alias("parent"), F.coalesce("_p", "plant").alias("plant")
    )
    changes = axes.where("idx % 7 = 3 or idx % 11 = 5").select(
        "doc", "idx", F.when(F.col("idx") % 11 != 5, 1 - F.col("plant")).alias("target")
    )
    return edits.reassign_axes(axes, changes, ["doc"], "idx", "parent", "plant")


EDITS = """ed AS (SELECT user_id % 10 AS grp, event_id AS seq, CAST(floor(value) AS INTEGER) % 64 AS x0, CAST(user_id % 64 AS INTEGER) AS y0,
  CAST(event_id % 9 AS INTEGER) AS w, CAST(event_id % 5 AS INTEGER) AS h, event_type IN ('error', 'view') AS erase FROM events),
filled AS (SELECT grp, seq, erase, x.x, y.y FROM ed, range(0, 64) x(x), range(0, 64) y(y) WHERE x.x BETWEEN x0 - w AND x0 AND y.y BETWEEN y0 AND y0 + h),
mask AS (SELECT grp, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM filled GROUP BY 1, 2, 3 HAVING NOT arg_max(erase, seq))"""


def mask_edits(spark, folder):
    x0 = F.floor("value").cast("int") % 64
    y0 = (F.col("user_id") % 64).cast("int")
    return table(spark, folder, "events").select(
        (F.col("user_id") % 10).alias("grp"), F.col("event_id").alias("seq"), F.lit("rectangle").alias("shape"),
        x0.alias("x0"), y0.alias("y0"), (x0 - (F.col("event_id") % 9).cast("int")).alias("x1"),
        (y0 + (F.col("event_id") % 5).cast("int")).alias("y1"), F.lit(1).alias("size"),
        F.col("event_type").isin("error", "view").alias("erase"),
    )


@query("mask_edit_log", f"WITH {EDITS} SELECT grp, x, y FROM mask")
def mask_edit_log(spark, folder):
    return edits.mask_from_edits(mask_edits(spark, folder), ["grp"], "seq", 64, 64)


@query("mask_strokes", """WITH s AS (SELECT event_id % 40 AS grp, event_id AS seq, CAST(event_id % 61 AS INTEGER) AS x0, CAST(event_id % 53 AS INTEGER) AS y0,
    CAST((event_id * 7) % 64 AS INTEGER) AS x1, CAST((event_id * 3) % 64 AS INTEGER) AS y1, 1 + event_id % 4 AS size, event_type = 'error' AS erase FROM events),
c AS (SELECT s.*, x.x, y.y, CASE WHEN x0 = x1 AND y0 = y1 THEN 0.0 ELSE least(1.0, greatest(0.0, ((x.x - x0) * (x1 - x0) + (y.y - y0) * (y1 - y0)) / CAST((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) AS DOUBLE))) END AS t
  FROM s, range(0, 64) x(x), range(0, 64) y(y))
SELECT grp, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM c
WHERE sqrt((x - x0 - t * (x1 - x0)) ** 2 + (y - y0 - t * (y1 - y0)) ** 2) <= size / 2.0
GROUP BY grp, x, y HAVING NOT arg_max(erase, seq)""")
def mask_strokes(spark, folder):
    key = F.col("event_id")
    strokes = table(spark, folder, "events").select(
        (key % 40).alias("grp"), key.alias("seq"), F.lit("stroke").alias("shape"),
        (key % 61).cast("int").alias("x0"), (key % 53).cast("int").alias("y0"),
        ((key * 7) % 64).cast("int").alias("x1"), ((key * 3) % 64).cast("int").alias("y1"),
        (1 + key % 4).cast("int").alias("size"), (F.col("event_type") == "error").alias("erase"),
    )
    return edits.mask_from_edits(strokes, ["grp"], "seq", 64, 64)


@query("pending_mask_changes", f"""WITH {EDITS}, applied AS (SELECT * FROM mask WHERE grp % 2 = 0 OR x % 16 <> 3)
SELECT DISTINCT grp FROM ((SELECT * FROM mask EXCEPT SELECT * FROM applied) UNION ALL (SELECT * FROM applied EXCEPT SELECT * FROM mask))""")
def pending_mask_changes(spark, folder):
    mask = edits.mask_from_edits(mask_edits(spark, folder), ["grp"], "seq", 64, 64)
    return edits.pending_groups(mask, mask.where("grp % 2 = 0 or x % 16 <> 3"), ["grp"])


@query("edit_owned_pixels", """WITH o AS (SELECT l_linenumber AS image, CAST(l_partkey % 64 AS INTEGER) AS x, CAST(l_orderkey % 64 AS INTEGER) AS y, l_suppkey % 3 AS owner, l_suppkey % 7 AS axis, l_quantity AS q FROM lineitem),
owned AS (SELECT DISTINCT image, x, y, owner FROM o), visible AS (SELECT DISTINCT image, x, y, owner, axis FROM o WHERE q > 45)
SELECT DISTINCT * FROM (SELECT image, x, y, owner FROM owned WHERE (image, x, y) NOT IN (SELECT (image, x, y) FROM visible)
UNION ALL SELECT image, x, y, CASE WHEN axis = 2 THEN 0 ELSE owner END FROM visible WHERE axis <> 5)""")
def edit_owned_pixels(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_linenumber").alias("image"), (F.col("l_partkey") % 64).cast("int").alias("x"),
        (F.col("l_orderkey") % 64).cast("int").alias("y"), (F.col("l_suppkey") % 3).alias("owner"),
        (F.col("l_suppkey") % 7).alias("axis"), "l_quantity",
    )
    owned = rows.select("image", "x", "y", "owner").distinct()
    visible = rows.where("l_quantity > 45").select("image", "x", "y", "owner", "axis").distinct()
    changes = rows.where("axis in (2, 5)").select("image", "axis").distinct().withColumn(
        "target", F.when(F.col("axis") == 2, F.lit(0).cast("long"))
    )
    return edits.edit_owned_pixels(owned, visible, ["image"], "owner", "axis", changes)


@query("plant_origins", """WITH s AS (SELECT l_suppkey % 20 AS grp, l_linenumber AS slot, l_partkey % 500 AS x, l_orderkey % 300 AS y FROM lineitem WHERE l_quantity <= 30),
m AS (SELECT grp, slot, CAST(round_even(quantile_cont(x, 0.5), 0) AS INTEGER) AS x, CAST(round_even(quantile_cont(y, 0.5), 0) AS INTEGER) AS y FROM s GROUP BY 1, 2)
SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY slot) - 1 AS INTEGER) AS slot, x, y FROM m""")
def plant_origins(spark, folder):
    stems = table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("grp"), F.col("l_linenumber").alias("slot"), (F.col("l_partkey") % 500).alias("x"),
        (F.col("l_orderkey") % 300).alias("y"), (F.col("l_quantity") > 30).alias("overridden"),
    )
    return measure.plant_origins(stems, ["grp"], "overridden")


@query("move_origin", """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_suppkey % 4 = 0 AND l_linenumber = 2 AND l_quantity <= 25 THEN 7 ELSE l_partkey % 64 END AS BIGINT) AS x,
  CAST(CASE WHEN l_suppkey % 4 = 0 AND l_linenumber = 2 AND l_quantity <= 25 THEN 9 ELSE l_orderkey % 64 END AS BIGINT) AS y, l_partkey FROM lineitem""")
def move_origin(spark, folder):
    stems = table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") % 4).alias("grp"), F.col("l_linenumber").alias("slot"), (F.col("l_partkey") % 64).alias("x"),
        (F.col("l_orderkey") % 64).alias("y"), (F.col("l_quantity") > 25).alias("overridden"), "l_orderkey", "l_partkey",
    )
    moves = spark.createDataFrame([(0, 2, 7, 9)], "grp long, slot int, x long, y long")
    out = edits.move_origin(stems, moves, ["grp"], "overridden")
    return out.select("l_orderkey", F.col("slot").alias("l_linenumber"), "x", "y", "l_partkey")


BOXES = """b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 10 AS cx, l_tax * 12.5 AS cy, l_quantity / 61.0 AS w, l_quantity / 91.0 AS h, (l_partkey % 360) * 1.0 AS deg,
  CAST(600 + l_partkey % 50 AS DOUBLE) AS iw, CAST(400 + l_suppkey % 30 AS DOUBLE) AS ih FROM lineitem)"""


def boxes(spark, folder):
    rows = table(spark, folder, "lineitem")
    box = fg.box(
        F.col("l_discount") * 10, F.col("l_tax") * 12.5, F.col("l_quantity") / 61.0, F.col("l_quantity") / 91.0,
        (F.col("l_partkey") % 360) * 1.0,
    )
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", box.alias("b"), (600 + F.col("l_partkey") % 50).cast("double").alias("iw"),
        (400 + F.col("l_suppkey") % 30).cast("double").alias("ih"),
    )


def r6(column, name):
    return (F.round(column, 6) + 0.0).alias(name)


@query("box_corners", f"""WITH {BOXES} SELECT l_orderkey, l_linenumber, round(cx*iw + (-w*iw/2)*cos(radians(deg)) - (-h*ih/2)*sin(radians(deg)), 6) AS x0,
  round(cy*ih + (-w*iw/2)*sin(radians(deg)) + (-h*ih/2)*cos(radians(deg)), 6) AS y0,
  round(cx*iw + (w*iw/2)*cos(radians(deg)) - (h*ih/2)*sin(radians(deg)), 6) AS x2, round(cy*ih + (w*iw/2)*sin(radians(deg)) + (h*ih/2)*cos(radians(deg)), 6) AS y2 FROM b""")
def box_corners(spark, folder):
    c = fg.box_corners(F.col("b"), F.col("iw"), F.col("ih"))
    rows = boxes(spark, folder).withColumn("c", c)
    return rows.select("l_orderkey", "l_linenumber", r6(F.col("c")[0]["x"], "x0"), r6(F.col("c")[0]["y"], "y0"), r6(F.col("c")[2]["x"], "x2"), r6(F.col("c")[2]["y"], "y2"))


@query("box_fit", f"""WITH {BOXES}, e AS (SELECT *, abs(cos(radians(deg)))*w*iw + abs(sin(radians(deg)))*h*ih AS ex, abs(sin(radians(deg)))*w*iw + abs(cos(radians(deg)))*h*ih AS ey FROM b),
f AS (SELECT *, least(1.0, iw / greatest(ex, 1e-9), ih / greatest(ey, 1e-9)) AS k FROM e)
SELECT l_orderkey, l_linenumber, round(least(greatest(cx*iw, ex*k/2), iw - ex*k/2) / iw, 4) AS cx, round(least(greatest(cy*ih, ey*k/2), ih - ey*k/2) / ih, 4) AS cy,
  round(w*k, 4) AS w, round(h*k, 4) AS h FROM f""")
def box_fit(spark, folder):
    rows = boxes(spark, folder).withColumn("f", fg.box_fit(F.col("b"), F.col("iw"), F.col("ih")))
    return rows.select("l_orderkey", "l_linenumber", *[(F.round(F.col("f")[c], 4) + 0.0).alias(c) for c in ("cx", "cy", "w", "h")])


@query("box_validity", """SELECT l_orderkey, l_linenumber, l_discount * 10 <= 1 AND l_quantity > 5 AS valid FROM lineitem""")
def box_validity(spark, folder):
    rows = table(spark, folder, "lineitem")
    box = fg.box(F.col("l_discount") * 10, F.lit(0.5), F.col("l_quantity") - 5, F.lit(1.0), F.lit(0.0))
    return rows.select("l_orderkey", "l_linenumber", fg.box_is_valid(box).alias("valid"))


@query("box_extraction", f"""WITH {BOXES}, p AS (SELECT *, greatest(1.0, round_even(w*iw, 0)) AS ow, greatest(1.0, round_even(h*ih, 0)) AS oh, cos(radians(deg)) AS c, sin(radians(deg)) AS s FROM b),
m AS (SELECT *, cx*iw - 0.5 - c*(ow-1)/2 + s*(oh-1)/2 AS tx, cy*ih - 0.5 - s*(ow-1)/2 - c*(oh-1)/2 AS ty FROM p)
SELECT l_orderkey, l_linenumber, CAST(ow AS INTEGER) AS out_w, CAST(oh AS INTEGER) AS out_h, greatest(w*iw, h*ih) <= sqrt(iw*iw + ih*ih) + 1 AS ok,
  round(tx, 6) AS tx, round(ty, 6) AS ty, round(-(c*tx + s*ty), 6) AS back_x, round(-(-s*tx + c*ty), 6) AS back_y FROM m""")
def box_extraction(spark, folder):
    rows = boxes(spark, folder).withColumn("e", fg.box_extraction(F.col("b"), F.col("iw"), F.col("ih")))
    e = F.col("e")
    return rows.select(
        "l_orderkey", "l_linenumber", e["out_w"].alias("out_w"), e["out_h"].alias("out_h"), e["ok"].alias("ok"),
        r6(e["to_source"][2], "tx"), r6(e["to_source"][5], "ty"), r6(e["to_crop"][2], "back_x"), r6(e["to_crop"][5], "back_y"),
    )


@query("box_unrotate", f"""WITH {BOXES}, t AS (SELECT *, CAST(l_partkey % 4 * 90 AS DOUBLE) AS rot FROM b),
g AS (SELECT *, round(cos(radians(rot)), 9) AS c, round(sin(radians(rot)), 9) AS s, CASE WHEN l_partkey % 2 = 1 THEN ih ELSE iw END AS ow, CASE WHEN l_partkey % 2 = 1 THEN iw ELSE ih END AS oh FROM t),
m AS (SELECT *, (ow-1)/2 - c*(iw-1)/2 + s*(ih-1)/2 AS tx, (oh-1)/2 - s*(iw-1)/2 - c*(ih-1)/2 AS ty FROM g)
SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, round((c*(cx*ow-0.5-tx) + s*(cy*oh-0.5-ty) + 0.5) / iw, 6) AS cx, round((-s*(cx*ow-0.5-tx) + c*(cy*oh-0.5-ty) + 0.5) / ih, 6) AS cy,
  round(w*ow/iw, 6) AS w, round(h*oh/ih, 6) AS h, CAST(round(deg - rot, 6) AS DOUBLE) AS deg FROM m""")
def box_unrotate(spark, folder):
    rot = (F.col("l_partkey") % 4) * 90.0
    rows = boxes(spark, folder).withColumn("u", fg.box_unrotate(F.col("b"), F.col("iw"), F.col("ih"), rot))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[r6(F.col("u")[c], c) for c in ("cx", "cy", "w", "h", "deg")]).distinct()


@query("affine_points", """SELECT l_orderkey, l_linenumber, round(0.5*l_quantity - 2.0*l_tax + l_discount, 6) AS x, round(1.5*l_quantity + 0.25*l_tax - l_discount, 6) AS y FROM lineitem""")
def affine_points(spark, folder):
    m = F.array(F.lit(0.5), F.lit(-2.0), F.col("l_discount"), F.lit(1.5), F.lit(0.25), -F.col("l_discount"))
    points = F.array(F.struct(F.col("l_quantity").alias("x"), F.col("l_tax").alias("y")))
    rows = table(spark, folder, "lineitem").withColumn("p", fg.affine_points(m, points))
    return rows.select("l_orderkey", "l_linenumber", r6(F.col("p")[0]["x"], "x"), r6(F.col("p")[0]["y"], "y"))


@query("search_polygon", f"""WITH {BOXES}, p AS (SELECT *, l.l_extendedprice % 600 AS px, (l.l_extendedprice * 7) % 400 AS py FROM b JOIN lineitem l USING (l_orderkey, l_linenumber))
SELECT DISTINCT l_orderkey, l_linenumber, abs((px-cx*iw)*cos(radians(deg)) + (py-cy*ih)*sin(radians(deg))) <= w*iw/2 AND abs(-(px-cx*iw)*sin(radians(deg)) + (py-cy*ih)*cos(radians(deg))) <= h*ih/2 AS inside FROM p""")
def search_polygon(spark, folder):
    prices = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    rows = boxes(spark, folder).join(prices, ["l_orderkey", "l_linenumber"])
    rows = rows.withColumn("c", fg.box_corners(F.col("b"), F.col("iw"), F.col("ih")))
    inside = fg.inside_polygon(F.col("l_extendedprice") % 600, (F.col("l_extendedprice") * 7) % 400, F.col("c"))
    return rows.select("l_orderkey", "l_linenumber", inside.alias("inside")).distinct()
