"""Scenes with closed-form answers and brute-force comparisons."""

import itertools
import os
import random
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phenoframe.functions import camera, text as ft
from phenoframe.operators import chains, components, linking, ordered, order, registration, skeleton, spatial, static, stems, tiles
from phenoframe.params import Params, settings_table, stage_hashes, violations
from phenoframe.sources import documents, images, sinks


def px(spark, points, image=0):
    return spark.createDataFrame([(image, int(x), int(y)) for x, y in points], "image int, x int, y int")


def test_ordered_columns_agree_when_a_group_is_split(spark):
    rng = random.Random(1)
    rows = [(0 if i % 3 else i % 7, i, rng.choice([None, 1.0, 2.0]), rng.randint(0, 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, t int, v double, n int")
    args = dict(lags={"a": F.col("v")}, known={"k": F.col("v")}, sums={"s": F.col("n")}, number="r")
    plain = ordered.ordered_columns(df, ["g"], ["t"], bounded=True, **args)
    split = ordered.ordered_columns(df, ["g"], ["t"], **args)
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, split.select(plain.columns).collect()), key=repr)


@pytest.mark.parametrize("name,date", [
    ("RT.26-04-27.JPG", "2026-04-27"), ("RT.26-4-7_1.jpg", "2026-04-07"), ("RT.99-01-02.png", "1999-01-02"),
    ("bad.99-99-99.JPG", None), ("readme.txt", None), ("a.b.26-04-27.JPG", None),
])
def test_names(spark, name, date):
    row = images.parse_names(spark.createDataFrame([(f"/d/{name}",)], "path string")).first()
    assert (str(row.date)[:10] if row.date else None) == date


def test_legacy_suffix(spark):
    df = spark.createDataFrame([("s.20220925_143045",)], "path string")
    fmt = dict(date_format="%Y%m%d_%H%M%S", template="{group}.{date}")
    stem = df.withColumn("path", F.concat("path", F.lit(".jpg")))
    assert str(images.parse_names(stem, **fmt).first().date) == "2022-09-25 14:30:45"
    assert images.parse_names(stem, legacy=True, **fmt).first().date is None


def test_list_images(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    for name in ("a.26-01-01.jpg", "aside/b.26-01-02.jpg", "deep/c.26-01-03.jpg"):
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        open(f"{root}/{name}", "w").write("x")
    found = {r.file_name for r in images.dated_series(images.list_images(spark, root), include_set_aside=True).collect()}
    assert found == {"a.26-01-01.jpg", "b.26-01-02.jpg"}


def test_camera_text(spark):
    cases = [
        ("EXIF:ExposureTime", "0.004", "Exposure time", "1/250 s"), ("EXIF:FNumber", "f/4.0", "Aperture", "f/4"),
        ("EXIF:ISO", "200", "ISO sensitivity", "200"), ("EXIF:FocalLength", "35 mm", "Focal length", "35 mm"),
        ("EXIF:ExposureTime", "0.033333333", "Exposure time", "1/30 s"), ("EXIF:SubjectDistance", "inf", "Focus distance", "Infinity"),
        ("EXIF:ISO", "12345678", "ISO sensitivity", "1.23457e+07"), ("EXIF:MeteringMode", "3", "Light metering", "Spot"),
    ]
    df = spark.createDataFrame([(i, {k: v}) for i, (k, v, _, _) in enumerate(cases)], "i int, tags map<string,string>")
    got = {r.i: (r.setting, r.value) for r in camera.photo_settings(df, ["i"], "tags").collect()}
    assert got == {i: (s, v) for i, (_, _, s, v) in enumerate(cases)}


def outline(n):
    return {(x, y) for x in range(n) for y in range(n) if {x, y} & {0, n - 1}}


def comb(teeth, height):
    return {(x, 0) for x in range(2 * teeth + 1)} | {(2 * t + 1, y) for t in range(teeth) for y in range(1, height + 1)}


# A line of n pixels has n - 1 steps whatever its direction, a closed outline as many as pixels, a tree one less.
@pytest.mark.parametrize("points,steps", [
    ({(i, i % 2) for i in range(40)}, 39), ({(i, -i) for i in range(17)} | {(60, 60)}, 16), (outline(9), 4 * 8),
    (comb(6, 5), 13 + 6 * 5 - 1), (outline(6) | {(x + 30, y) for x, y in comb(2, 3)}, 4 * 5 + 5 + 2 * 3 - 1),
])
def test_polyline_steps(spark, points, steps):
    rows = chains.trace_polylines(px(spark, points), ["image"])
    walk = rows.groupBy("path_a", "path_b").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p")).collect()
    taken = [(tuple(a[1:]), tuple(b[1:])) for r in walk for a, b in zip(r.p, r.p[1:])]
    assert len(taken) == len(set(map(frozenset, taken))) == steps
    assert {p for r in walk for p in map(lambda v: tuple(v[1:]), r.p)} == points
    assert all({abs(a[0] - b[0]), abs(a[1] - b[1])} <= {0, 1} for a, b in taken)


def test_components_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    points = {(rng.randint(0, 150), rng.randint(0, 20)) for _ in range(900)}
    seen, want = {}, {}
    for start in sorted(points, key=lambda p: (p[1], p[0])):
        if start in seen:
            continue
        todo = [start]
        while todo:
            p = todo.pop()
            if p in points and p not in seen:
                seen[p] = start
                todo += [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    want = {p: s[1] * 2**32 + s[0] for p, s in seen.items()}
    for parts in (1, 7):
        got = {(r.x, r.y): r.label for r in components.label_pixels(px(spark, points).repartition(parts), ["image"]).collect()}
        assert got == want


def test_nearest_is_exact(spark):
    rng = random.Random(5)
    a = {(rng.randint(0, 199), rng.randint(0, 199)) for _ in range(80)}
    b = {(rng.randint(0, 40), rng.randint(0, 199)) for _ in range(60)}
    got = {(r.x, r.y): r.d2 for r in spatial.nearest(px(spark, a), px(spark, b), ["image"]).collect()}
    assert got == {p: min((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 for q in b) for p in a}


def thin_reference(points):
    points = set(points)
    ring = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]
    while True:
        before = len(points)
        for first in (True, False):
            gone = set()
            for x, y in points:
                p = [(x + i, y + j) in points for i, j in ring]
                rises = sum(not a and b for a, b in zip(p, p[1:] + p[:1]))
                n, e, s, w = p[0], p[2], p[4], p[6]
                free = not (n and e and s) and not (e and s and w) if first else not (n and e and w) and not (n and s and w)
                if 2 <= sum(p) <= 6 and rises == 1 and free:
                    gone.add((x, y))
            points -= gone
        if len(points) == before:
            return points


def test_thinning_matches_brute_force(spark):
    shape = {(x, y) for x in range(5, 40) for y in range(10, 17)} | {(x, y) for x in range(18, 25) for y in range(10, 40)}
    got = {(r.x, r.y) for r in skeleton.thin(px(spark, shape), ["image"]).collect()}
    assert got == thin_reference(shape)


def test_width_of_a_bar(spark):
    bar = {(x, y) for x in range(5, 40) for y in range(10, 17)}
    got = skeleton.widths(px(spark, [(20, 13)]), px(spark, bar), ["image"], 64, 64).first()
    assert got.width == 8.0


def static_scene(jitter=False, missing=False, late=False):
    rows = []
    for frame in range(4):
        d = frame % 2 if jitter else 0
        rows += [(0, frame, 30, y) for y in range(10, 40 + 8 * frame)]
        if not (missing and frame == 2):
            rows += [(0, frame, 65 + d + k // 2, 35 + k) for k in range(11)]
        if late and frame == 3:
            rows += [(0, frame, 80, y) for y in range(60, 70)]
    return rows


@pytest.mark.parametrize("kind,removed", [({}, True), ({"jitter": True}, True), ({"missing": True}, False), ({"late": True}, True)])
def test_static_objects(spark, kind, removed):
    fg = spark.createDataFrame(static_scene(**kind), "grp int, frame int, x int, y int")
    origins = spark.createDataFrame([(0, 30, 10)], "grp int, x int, y int")
    frames = fg.select("grp", "frame").distinct().withColumn("usable", F.lit(True))
    kept = {(r.frame, r.x, r.y) for r in static.drop_static(fg, origins, frames, ["grp"], "frame", 128).collect()}
    want = {(f, x, y) for _, f, x, y in static_scene(**kind) if not (removed and 60 < x < 75)}
    assert kept == want


def test_stems_match_exhaustive_search(spark):
    xs = [3, 5, 8, 40, 42, 47, 90, 95, 120, 122]
    regions = spark.createDataFrame([(0, x, x, 5, 5, 10) for x in xs], "image int, min_x int, max_x int, min_y int, max_y int, area int")
    got = [r.x for r in stems.cluster_stems(regions, ["image"], 4).orderBy("slot").collect()]
    def cost(cuts):
        return sum(np.var(p) * len(p) for p in np.split(np.array(xs), cuts))
    best = min(itertools.combinations(range(1, len(xs)), 3), key=cost)
    want = [int(np.around(np.median(np.array(p) + 0.5))) for p in np.split(np.array(xs), best)]
    assert got == want
    assert stems.cluster_stems(regions.limit(3), ["image"], 4).count() == 0


def test_tile_seams_are_exact(spark):
    image = np.random.default_rng(1).integers(0, 255, (40, 50, 3)).astype(np.uint8)
    row = spark.createDataFrame(
        [("i", 50, 40, 3, bytearray(image.tobytes()))], "image_id string, width int, height int, channels int, data binary"
    )
    def whole(size):
        out = tiles.remove_gradient(tiles.cut_tiles(row, size), 5, 2, size)
        return {(r.x, r.y): r.v for r in tiles.tile_pixels(out, ["v"], keep_zero=True).collect()}
    assert whole(16) == whole(64)
    padded = np.pad(image, ((5, 5), (5, 5), (0, 0)), mode="edge")
    assert tiles.median_filter(padded, 5)[7, 9, 1] == int(np.median(padded[7:18, 9:20, 1]))


def test_registration_recovers_an_offset(spark):
    rng = random.Random(2)
    base = {(rng.randint(300, 1500), rng.randint(300, 1500)) for _ in range(700)}
    rows = [(0, x, y) for x, y in base] + [(1, x + 37, y - 22) for x, y in base]
    edges = spark.createDataFrame(rows, "f int, x int, y int")
    got = registration.pair_offsets(edges, [], "f", 1800, 1800).first()
    assert (got.dx, got.dy) == (-37, 22)


def greedy_links(kids, olds, stems_, spacing, cost):
    owner, todo = {("s", s): o for s, (_, _, o) in stems_.items()}, sorted(kids, key=lambda k: (kids[k][1], k))
    out = {}
    for k in todo:
        options = [(cost(kids[k], p, True), ("s", s)) for s, p in stems_.items()]
        options += [(cost(kids[k], olds[p], False), p) for p in olds if p != k and p in owner]
        options = [(c, p) for c, p in options if c is not None]
        if options:
            best = min(options, key=lambda o: o[0])
            owner[k], out[k] = owner[best[1]], owner[best[1]]
    return out


def test_link_rounds_match_the_ordered_greedy(spark):
    rng = random.Random(9)
    segs, kids, olds = [], {}, {}
    for i in range(60):
        x, y = rng.randint(0, 200), 20 + i * 5
        lx, ly = x + rng.randint(-6, 6), y + rng.randint(8, 25)
        a, b = rng.uniform(200, 340), rng.uniform(40, 140)
        segs.append((0, i, x, y, lx, ly, a, b, None, None, False, None))
        kids[i], olds[i] = (x, y, a), (lx, ly, b)
    roots = {s: (30 + 50 * s, 10, s) for s in range(4)}
    def turn(a, b):
        return abs((a - b + 180) % 360 - 180)
    def cost(kid, old, stem):
        if old[1] > kid[1]:
            return None
        d = np.hypot(kid[0] - old[0], kid[1] - old[1])
        if stem and (abs(kid[0] - old[0]) > 25 or abs(kid[1] - old[1]) > 33):
            return None
        if not stem and d > 25:
            return None
        down, low = (kid[2] + 180) % 360, 90.0 if stem else old[2]
        pred = np.degrees(np.arctan2(old[1] - kid[1], old[0] - kid[0])) + 180
        return d + turn(down, low) * 50 / 720 + (turn(pred, down) + turn(pred, low)) * 50 / 360
    want = greedy_links(kids, olds, roots, 50, cost)
    schema = ("g int, seg long, upper_x int, upper_y int, lower_x int, lower_y int, upper_angle double, lower_angle double, "
              "upper_junction long, lower_junction long, lower_is_tip boolean, component long")
    segments = spark.createDataFrame(segs, schema)
    stems_df = spark.createDataFrame([(0, o, x, y) for x, y, o in roots.values()], "g int, owner int, x int, y int")
    none = segments.select("g", "seg", F.lit(None).cast("int").alias("owner")).where("false")
    got = {r.seg: r.owner for r in linking.link_rounds(segments, stems_df, none, segments, ["g"], 50.0, 512, gate=False).collect()}
    assert got == want


def test_assignment_is_optimal():
    rng = np.random.default_rng(4)
    for n, m in ((3, 3), (2, 5), (5, 2), (4, 6)):
        cost = rng.integers(0, 50, (n, m)).astype(float)
        got = sum(cost[r, c] for r, c in linking.assign(cost))
        small, large = (cost, m) if n <= m else (cost.T, n)
        want = min(sum(small[i, p] for i, p in enumerate(perm)) for perm in itertools.permutations(range(large), min(n, m)))
        assert got == want


def test_documents_and_exports(spark):
    points = "".join(f'<point x="{x}" y="{y}"/>' for x, y in ((10, 10), (10, 20)))
    child = '<root id="c"><geometry><polyline><point x="10" y="15"/><point x="13" y="19"/></polyline></geometry></root>'
    xml = f'<rsml><scene><plant id="1"><root id="m"><geometry><polyline>{points}</polyline></geometry>{child}</root></plant></scene></rsml>'
    root = tempfile.mkdtemp(prefix="spark-")
    open(f"{root}/a.rsml", "w").write(xml)
    axes = documents.read_documents(spark, root).orderBy("root_index").collect()
    assert [(a.root_id, a.parent_index, a.plant_index) for a in axes] == [("m", None, 0), ("c", 0, 0)]
    copy = spark.createDataFrame([("b.rsml", bytearray(xml.encode()))], "file_name string, source binary")
    sinks.write_documents(copy, root)
    assert open(f"{root}/b.rsml").read() == xml
    line = spark.createDataFrame([("g/x", 0, 1, 5, i, 3 + i, 4) for i in range(3)] + [("g/x", 0, 1, 6, 0, 9, 9)],
                                 "group_id string, frame_no int, plant int, path long, pos int, x int, y int")
    image = spark.createDataFrame([("g/x", 0, "a.jpg")], "group_id string, frame_no int, file_name string").withColumn(
        "date", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    documents.write_geometry(documents.geometry_lines(line, image), f"{root}/out")
    folder = f"{root}/out/" + [d for d in os.listdir(f"{root}/out") if d.startswith("folder=")][0]
    text = "".join(
        open(os.path.join(p, f)).read() for p, _, fs in os.walk(folder) for f in sorted(fs) if f.endswith(".txt")
    )
    rows = documents.document_rows("x", text.encode())
    assert [r["points"] for r in rows] == [[[3, 4], [4, 4], [5, 4]], [[9, 9], [9, 9]]]
    with pytest.raises(Exception):
        documents.write_geometry(documents.geometry_lines(line, image), f"{root}/out")


def wrapped(inside, meta="", head="<rsml>", tail="</rsml>"):
    return f'{head}<metadata>{meta}</metadata><scene><plant id="7">{inside}</plant></scene>{tail}'.encode()


def axis(*points, inside=""):
    return "<root><geometry><polyline>" + "".join(f"<point {p}/>" for p in points) + f"</polyline></geometry>{inside}</root>"


@pytest.mark.parametrize("raw,reason", [
    (wrapped(axis('x="1" y="2"', 'x="1" y="2" z="3"')), "invalid polyline"), (wrapped(axis('x="1"')), "invalid polyline"),
    (wrapped(axis('x="1" y="inf"'), tail=""), "not well-formed"), (b"", "not well-formed"), (b"<rsml/>", "no scene"),
    (wrapped(axis(), head="<other>", tail="</other>"), "no scene"), (wrapped(axis(), "<resolution/>"), "resolution"),
    (b"<!DOCTYPE rsml>" + wrapped(axis()), "DTD or entity"), (wrapped("<root>" * 254 + "</root>" * 254), "too complex"),
    (b" " * (documents.MAX_BYTES + 1), "too large"), (wrapped("<a/>" * documents.MAX_ELEMENTS), "too complex"),
])
def test_refused_documents(raw, reason):
    assert documents.document_rows("p", raw) == [{"path": "p", "reason": reason}]


def test_axes_of_nested_documents():
    inner = axis('x="4" y="5" z="6"', inside="<note>" + axis('x="0" y="0"') + "</note>")
    raw = wrapped(axis('x="1" y="2"', 'x="3" y="4"', inside=inner + axis()) + axis(), "<unit>mm</unit><resolution>4</resolution><unit>cm</unit>",
                  head='<rsml xmlns="urn:a" xmlns:b="urn:b"><b:scene/>')
    rows = documents.document_rows("p", raw)
    assert [(r["root_index"], r["parent_index"], r["points"]) for r in rows] == [
        (0, None, [[1, 2], [3, 4]]), (1, 0, [[4, 5, 6]]), (2, 0, []), (3, None, [])]
    assert {(r["unit"], r["resolution"], r["n_plants"], r["plant_id"], r["image_name"]) for r in rows} == {("mm", 4, 1, "7", "")}
    assert len(documents.document_rows("p", wrapped("<root>" * 253 + "</root>" * 253))) == 253
    assert [r.get("root_index") for r in documents.document_rows("p", wrapped(""))] == [None]


def test_statistics_csv(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    stats = spark.createDataFrame([("p.jpg", 1, 5.0)], "image_path string, plant_id int, plant_total_length double")
    sinks.write_statistics(stats, f"{root}/s", has_overrides=False)
    back = spark.read.option("header", True).csv(f"{root}/s")
    assert len(back.columns) == 19 and back.first().plant_total_length == "5.0"


def test_settings(spark):
    groups = spark.createDataFrame([("a",)], "group_id string")
    base = Params.from_dict({"rotation": 180, "threshold": {"show_max_root_depth": True}, "gui": {"auto_apply": True}})
    assert violations(settings_table(groups, "group_id", base), "group_id").count() == 0
    one = stage_hashes(settings_table(groups, "group_id", base)).first()
    two = stage_hashes(settings_table(groups, "group_id", Params(rotation=180.0))).first()
    assert (one.prepare_hash, one.track_hash) == (two.prepare_hash, two.track_hash)
    other = Params()
    other.threshold.low = 25
    three = stage_hashes(settings_table(groups, "group_id", other)).first()
    assert three.prepare_hash == one.prepare_hash and three.track_hash != one.track_hash


def test_cycles_are_refused(spark):
    links = spark.createDataFrame([(1, 2), (2, 1)], "child long, parent long")
    with pytest.raises(ValueError):
        order.dependency_levels(links, [], "child", "parent")


def test_bridge_paths(spark):
    bridges = spark.createDataFrame([(1, 10, 11), (2, 11, 12), (3, 12, 13)], "seg long, upper_junction long, lower_junction long")
    trips = spark.createDataFrame([(0, 13, 11), (1, 10, 10)], "trip int, start long, end long")
    got = {(r.trip, r.seg) for r in order.crossed_bridges(bridges, trips, []).collect()}
    assert got == {(0, 3), (0, 2)}


def test_plans_stay_on_the_jvm_without_cartesian_products(spark):
    from phenoframe.plans import catalog

    for name in ("nearest_within", "growth_rate", "neighbour_count", "link_candidates", "settings_drift"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
        assert "Python" not in plan and "Pandas" not in plan, name


def test_axis_paths_have_no_depth_limit(spark):
    from phenoframe.operators import edits

    axes = spark.range(600).select(F.lit(1).alias("doc"), F.col("id").cast("int").alias("i"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("int")).alias("up"))
    paths = {r.i: len(r.path) for r in edits.axis_paths(axes, ["doc"], "i", "up").collect()}
    assert paths == {i: i + 1 for i in range(600)}
    circle = spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "doc int, i int, up int")
    with pytest.raises(ValueError):
        edits.axis_paths(circle, ["doc"], "i", "up")


def test_nearest_has_no_extent(spark):
    from phenoframe.operators import spatial

    points = spark.createDataFrame([(1, 0, 0), (1, -500, 90), (1, 4000, 7)], "image int, x int, y int")
    targets = spark.createDataFrame([(1, 100, 3), (1, -40, -1000), (1, 3000, 3000)], "image int, x int, y int")
    got = {(r.x, r.y): (r.tx, r.ty, r.d2) for r in spatial.nearest(points, targets, ["image"]).collect()}
    want = {}
    for p in points.collect():
        d2, ty, tx = min(((p.x - t.x) ** 2 + (p.y - t.y) ** 2, t.y, t.x) for t in targets.collect())
        want[p.x, p.y] = (tx, ty, d2)
    assert got == want
    assert spatial.nearest(points, targets.limit(0), ["image"]).count() == 0


def test_stems_that_share_a_column_stay(spark):
    from phenoframe.operators import stems

    rows = [(1, 10, 12, 0, 4, 5), (1, 10, 12, 50, 54, 6), (1, 40, 42, 0, 4, 7), (1, 80, 82, 0, 4, 8), (2, 1, 3, 0, 2, 9)]
    regions = spark.createDataFrame(rows, "image int, min_x int, max_x int, min_y int, max_y int, area int")
    got = stems.cluster_stems(regions, ["image"], 4).orderBy("slot").collect()
    assert [(r.image, r.slot, r.area) for r in got] == [(1, 0, 5), (1, 1, 6), (1, 2, 7), (1, 3, 8)]


def test_offsets_above_the_cell_limit(spark):
    import random

    from phenoframe.operators import registration

    draw = random.Random(3)
    marks = {(draw.randrange(20, 380), draw.randrange(20, 380)) for _ in range(400)}
    rows = [(0, x, y) for x, y in marks] + [(1, x + 13, y - 9) for x, y in marks]
    edges = spark.createDataFrame(rows, "frame int, x int, y int")
    exact = registration.pair_offsets(edges, [], "frame", 400, 400).collect()
    coarse = registration.pair_offsets(edges, [], "frame", 400, 400, cells=128).collect()
    assert exact == coarse == [exact[0]] and (exact[0].dx, exact[0].dy) == (-13, 9)


def test_documents_keep_inside_their_folder(spark, tmp_path):
    from phenoframe.sources import sinks

    bad = spark.createDataFrame([("../escape.xml", bytearray(b"x"))], "file_name string, source binary")
    with pytest.raises(Exception, match="plain file name"):
        sinks.write_documents(bad, str(tmp_path / "out"))
