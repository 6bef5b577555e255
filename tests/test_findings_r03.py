"""Scenes of the third review: each failed before its finding was settled."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from phenoframe.operators import evidence, forest, linking, luminance, mainaxis, matching, spatial, stems, tiles
from phenoframe.plans import contacts as contacts_plan, ownership, plates, prepared, tracking

ENDS = "img int, {0} long, x int, y int, angle double"


def test_every_parent_of_one_place_is_a_candidate(spark):
    children = spark.createDataFrame([(0, 1, 10, 12, 270.0), (0, 2, 10, 12, 270.0)], ENDS.format("child"))
    parents = spark.createDataFrame(
        [(0, 3, 10, 8, 90.0, False), (0, 4, 10, 8, 90.0, False), (0, 5, 10, 8, 90.0, None)], ENDS.format("parent") + ", is_stem boolean")
    pairs = matching.link_candidates(children, parents, ["img"], 40.0)
    assert {(r.child, r.parent) for r in pairs.collect()} == {(c, p) for c in (1, 2) for p in (3, 4, 5)}
    assert pairs.select("cost").distinct().count() == 1


def test_parents_of_one_place_leave_no_single_nearest(spark):
    children = spark.createDataFrame([(0, 1, 10, 12, 270.0), (1, 2, 10, 12, 270.0)], ENDS.format("child"))
    parents = spark.createDataFrame(
        [(0, 3, 10, 8, 90.0, False), (0, 4, 10, 8, 90.0, False), (1, 5, 10, 8, 90.0, False)], ENDS.format("parent") + ", is_stem boolean")
    pairs = matching.link_candidates(children, parents, ["img"], 40.0).withColumn("d", F.round("cost").cast("long"))
    assert [(r.child, r.parent) for r in matching.mutual_nearest(pairs, ["img"], "child", "parent", "d").collect()] == [(2, 5)]


def test_samples_of_long_steps_are_all_compared(spark, tmp_path):
    rows = [(0, 1, 10.0), (1, 1, 900.0), (2, 1, 5.0), (3, 1, 70.0), (4, 3, 3.0), (5, 3, 80.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = tracking.visible_runs(spark, str(tmp_path)).select("user_id", "piece", "n_points", "sum_x").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(tracking.VISIBLE).fetchall())


def test_sums_of_pieces_do_not_depend_on_the_order(spark):
    # 0.0005 on paper; as doubles the sum of the halves falls on either side of the tie.
    rows = [(1, 1, v) for v in (1e9, 0.00025, 0.00025)]
    pieces = spark.createDataFrame(rows, "user_id long, piece long, x double")
    assert tracking.piece_sums(pieces).first().sum_x == 1000000000.001


def test_nearest_end_above_with_the_smallest_name(spark):
    rng = random.Random(7)
    points = [(k, rng.randint(-9, 60), rng.randint(-9, 60)) for k in (0, 1) for _ in range(120)]
    targets = [(k, rng.randint(0, 50), rng.randint(0, 50), i) for k in (0, 1) for i in range(80)]
    got = spatial.nearest(
        spark.createDataFrame(points, "k int, x int, y int"), spark.createDataFrame(targets, "k int, x int, y int, seg long"), ["k"],
        above=True, rank="seg").collect()
    want = {}
    for k, x, y in points:
        near = [((tx - x) ** 2 + (ty - y) ** 2, s) for g, tx, ty, s in targets if g == k and ty <= y]
        if near:
            want[k, x, y] = min(near)
    assert {(r.k, r.x, r.y): (r.d2, r.seg) for r in got} == want


def test_lines_of_one_number_and_part_are_ordered_by_supplier(spark, tmp_path):
    rows = [(11, 1, 5, s) for s in (9, 3, 7)] + [(11, 2, 6, 4)]
    for turn in (rows, rows[::-1]):
        folder = f"{tmp_path}/{turn[0][3]}"
        spark.createDataFrame(turn, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
        con = duckdb.connect()
        con.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet/*.parquet'")
        assert con.sql(f"WITH {ownership.SPLIT.split('s AS (')[0].rstrip().rstrip(',')} SELECT y FROM p ORDER BY pos").fetchall()[0] == (28,)


def test_descent_through_circles_takes_no_more_rows_than_pairs(spark):
    rng = random.Random(5)
    up = {(g, i): (rng.choice([None, 99, *range(24)]) if g < 6 else (i + 1) % 24) for g in range(7) for i in range(24)}

    def above(g, i):
        seen = set()
        while i is not None and i not in seen and (g, i) in up:
            seen.add(i)
            i = up[g, i]
        return seen

    links = spark.createDataFrame([(g, i, p) for (g, i), p in up.items()], "img int, seg long, parent long")
    pairs = spark.createDataFrame([(g, a, b) for g in range(7) for a in range(24) for b in range(24)], "img int, arrival long, tip long")
    got = forest.descending(pairs, links, ["img"], "seg", "parent", "arrival", "tip")
    assert set(map(tuple, got.select("img", "arrival", "tip").collect())) == {(g, a, b) for g in range(7) for a in range(24) for b in above(g, a)}


def test_carried_sections_broadcast_nothing(spark, capsys):
    contacts_plan.carried_widths(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "Join" in plan and "BroadcastExchange" not in plan


def test_only_near_gaps_are_measured(spark, monkeypatch):
    # Two strokes of ten rows: the second begins 4 below the first, a third 14 below the second, inside the same cells.
    spans = [(1, -1, 0, 10), (2, -1, 14, 24), (3, -1, 38, 48)]
    nodes = spark.createDataFrame(
        [(0, s, p, 5, a, 5, b, None) for s, p, a, b in spans],
        "img int, seg long, parent long, upper_x int, upper_y int, lower_x int, lower_y int, upper_junction long")
    points = spark.createDataFrame([(0, s, i, 5, a + i) for s, _, a, b in spans for i in range(b - a + 1)], "img int, seg long, pos int, x int, y int")
    measured, arm = [], mainaxis._arm
    monkeypatch.setattr(mainaxis, "_arm", lambda ends, *rest: measured.append(ends.count()) or arm(ends, *rest))
    got = mainaxis.forward_gaps(nodes, points, ["img"]).collect()
    assert [(r.seg, r.parent) for r in got] == [(2, 1)]
    assert measured == [1, 1]


def test_nearest_gated_end_by_manhattan_distance(spark):
    rng = random.Random(11)
    points = [(k, rng.randint(-9, 60), rng.randint(0, 60)) for k in (0, 1) for _ in range(100)]
    targets = [(k, rng.randint(0, 30), rng.randint(0, 30), rng.randint(0, 60), i) for k in (0, 1) for i in range(300)]
    got = spatial.nearest(
        spark.createDataFrame(points, "k int, x int, y int"), spark.createDataFrame(targets, "k int, x int, y int, after int, seg long"), ["k"],
        rank="seg", gate="after", manhattan=True).collect()
    want = {}
    for k, x, y in points:
        near = [(abs(tx - x) + abs(ty - y), s) for g, tx, ty, a, s in targets if g == k and a <= y]
        if near:
            want[k, x, y] = min(near)
    assert {(r.k, r.x, r.y): (r.d2, r.seg) for r in got} == want


SEGMENTS = ("img int, seg long, upper_x int, upper_y int, lower_x int, lower_y int, upper_angle double, lower_angle double, "
            "lower_is_tip boolean, component long")


def dense_scene(spark, seed, count, held):
    """Short strokes on a narrow image, with twins, flat ones and tips; components are columns of pixels."""
    rng, rows = random.Random(seed), []
    for img in (0, 1):
        for i in range(count):
            ux, uy = rng.randint(0, 40), rng.randint(4, 60)
            twin = rng.choice(rows)[2:8] if rows and i % 5 == 0 else (ux, uy, ux + rng.randint(-3, 3), uy + rng.choice([0, 3, 6, 9]), 270.0, float(rng.choice([60, 90, 120])))
            rows.append((img, 1000 * img + i, *twin, i % 9 == 4, rng.choice([None, 1, 2, 3])))
    segments = spark.createDataFrame(rows, SEGMENTS)
    stems = spark.createDataFrame([(0, 0, 10, 2), (0, 1, 30, 2)], "img int, owner int, x int, y int")
    forced = spark.createDataFrame([(r[0], r[1], r[1] % 2) for r in rows if held and r[0] == 0 and r[1] % held == 0], "img int, seg long, owner int")
    labelled = spark.createDataFrame(
        [(img, x, y, k) for img in (0, 1) for k, xs, ys in ((1, (0, 2), (0, 9)), (2, (8, 9), (0, 1)), (3, (30, 34), (4, 8)))
         for x in range(*xs) for y in range(*ys)], "img int, x int, y int, label long")
    return rows, segments, stems, forced, labelled


def plain_rounds(rows, pairs, stems, forced):
    """(img, seg) -> (owner, parent) of all that is decided in rounds over every candidate."""
    owned = {(s.img, -1 - s.owner): s.owner for s in stems.collect()} | {(f.img, f.seg): f.owner for f in forced.collect()}
    open_, out = {(r[0], r[1]) for r in rows} - set(owned), {}
    while True:
        won, gone = {}, set()
        for img, seg in open_:
            links = pairs.get((img, seg), [])
            best = min(((c, p, owned[img, p]) for c, p in links if (img, p) in owned), default=None)
            wait = min((c for c, p in links if (img, p) in open_), default=None)
            if best and (wait is None or best[0] <= wait):
                won[img, seg] = best[2], best[1]
            elif best is None and wait is None:
                gone.add((img, seg))
        if not won and not gone:
            return out
        out |= won
        owned |= {k: o for k, (o, _) in won.items()}
        open_ -= set(won) | gone


def test_links_are_decided_from_few_candidates(spark, monkeypatch):
    kept, cut = [], linking.cut
    monkeypatch.setattr(linking, "cut", lambda df, label="step": kept.append((label, cut(df, label))) or kept[-1][1])
    for seed, held, gate in ((1, 4, False), (2, 0, False), (3, 6, True)):
        rows, segments, stems, forced, labelled = dense_scene(spark, seed, 120, held)
        ends = segments.where("not lower_is_tip").selectExpr("img", "seg parent", "lower_x x", "lower_y y", "lower_angle angle", "false is_stem").unionByName(
            stems.selectExpr("img", "cast(-1 - owner as long) parent", "x", "y", "90D angle", "true is_stem"))
        full = matching.link_candidates(segments.selectExpr("img", "seg child", "upper_x x", "upper_y y", "upper_angle angle"), ends, ["img"], 40.0).where("child <> parent")
        if gate:
            named = full.join(segments.selectExpr("img", "seg child", "component child_label"), ["img", "child"]).join(
                segments.selectExpr("img", "seg parent", "component parent_label"), ["img", "parent"], "left").cache()
            full = evidence.gap_gate(named.where("child_label is not null and parent_label is not null"), labelled, ["img"]).unionByName(
                named.where("child_label is null or parent_label is null"))
        pairs = {}
        for r in full.collect():
            pairs.setdefault((r.img, r.child), []).append((r.cost, r.parent))
        kept.clear()
        got = linking.link_rounds(segments, stems, forced, labelled, ["img"], 40.0, 64, gate=gate).collect()
        held_segs = {(f.img, f.seg) for f in forced.collect()}
        assert {(r.img, r.seg): (r.owner, r.parent) for r in got if (r.img, r.seg) not in held_segs} == plain_rounds(rows, pairs, stems, forced)
        tops, places = {(r[0], r[1]): r for r in rows}, {(e.img, e.parent): e for e in ends.collect()}
        owners = {(r.img, r.seg): r.owner for r in got} | {(0, -1): 0, (0, -2): 1}
        for r in (r for r in got if (r.img, r.seg) in held_segs):
            x, y = tops[r.img, r.seg][2:4]
            near = [(abs(e.x - x) + abs(e.y - y), p) for (i, p), e in places.items()
                    if i == r.img and owners.get((i, p)) == r.owner and (tops[i, p][3] if p >= 0 else -1) < y]
            assert r.parent == min(near, default=(0, None))[1]
        if held == 4:
            # Image 0 holds owned ends: its 120 strokes have thousands of candidates, few of which can matter.
            few = next(df for label, df in kept if label == "pairs").where("img = 0").count()
            assert 4 * few < sum(len(v) for (i, _), v in pairs.items() if i == 0)


def test_restored_owners_descend_to_their_nearest_flow(spark, monkeypatch):
    rng, found, nearest = random.Random(3), [], linking.nearest
    monkeypatch.setattr(linking, "nearest", lambda *a, **k: found.append(nearest(*a, **k)) or found[-1])
    flows = {i: (rng.randint(0, 40), rng.randint(6, 60)) for i in range(60)}
    asks = {600 + j: (rng.randint(0, 40), rng.randint(0, 70)) for j in range(40)}
    rows = [(0, i, x, y - 5, x, y, 270.0, 90.0, None, None) for i, (x, y) in flows.items()]
    rows += [(0, 500, 50, 4, 50, 9, 270.0, 90.0, None, None)] + [(0, j, x, y, x, y + 5, 270.0, 90.0, None, None) for j, (x, y) in asks.items()]
    segments = spark.createDataFrame(rows, "img int, seg long, upper_x int, upper_y int, lower_x int, lower_y int, upper_angle double, "
                                     "lower_angle double, upper_junction long, lower_junction long")
    base = spark.createDataFrame([(0, i, -1, 20, 0) for i in flows] + [(0, 500, -2, 50, 0)] + [(0, j, 500, 50, 9) for j in asks],
                                 "img int, seg long, parent long, parent_x int, parent_y int")
    stems = spark.createDataFrame([(0, 0, 20, 0), (0, 1, 50, 0)], "img int, owner int, x int, y int")
    support = spark.createDataFrame([(0, j, 0, 0.9) for j in asks], "img int, seg long, support_owner int, share double")
    got = {r.seg: (r.owner, r.parent, r.parent_x, r.parent_y) for r in linking.route(segments, base, stems, support, ["img"]).collect() if r.seg >= 600}
    want = {}
    for j, (x, y) in asks.items():
        near = [((fx - x) ** 2 + (fy - y) ** 2, i) for i, (fx, fy) in flows.items() if fy <= y]
        if near:
            want[j] = (0, min(near)[1], *flows[min(near)[1]])
    assert got == want
    # Each search gives at most one row for a place, where all flows of the owner met before.
    assert found and max(f.count() for f in found) <= len(asks)


def test_plate_maps_are_dealt_and_worked_out_once(spark, capsys, monkeypatch):
    written, cut = {}, getattr(plates, "cut", None)
    monkeypatch.setattr(plates, "cut", lambda df, label: written.setdefault(label, df) and cut(df, label), raising=False)
    plates.plate_crop(spark, "/root/testdata/sf0.001").explain()
    assert "cos" not in capsys.readouterr().out.lower()
    assert written["frames"].rdd.getNumPartitions() > 1


def test_junctions_wait_until_everything_above_is_decided(spark):
    # q (6) goes on to n (4) or m (5); n hangs on the junction p (3), which goes on to A (1), where the earlier axis lies, or to B (2).
    kinds = "img int, seg long, parent long, upper_x int, upper_y int, lower_x int, lower_y int, upper_junction long, lower_junction long, component long, votes long, near int, unsure int"
    nodes = spark.createDataFrame([
        (0, 1, None, 10, 0, 10, 10, None, 1, 1, 5, 0, 0), (0, 2, None, 200, 0, 200, 10, None, 1, 2, 0, 0, 0), (0, 3, 1, 30, 20, 30, 30, 1, 2, 3, 0, 0, 0),
        (0, 4, 3, 10, 40, 10, 50, None, 7, 4, 3, 0, 0), (0, 5, None, 14, 12, 14, 50, None, 7, 5, 0, 0, 0), (0, 6, 5, 60, 70, 60, 80, 7, 8, 6, 1, 0, 0)], kinds)
    points = spark.createDataFrame([
        (0, r.seg, r.upper_x, y) for r in nodes.collect() for y in range(r.upper_y, r.lower_y + 1)], "img int, seg long, x int, y int")
    previous = spark.createDataFrame([(0, 10, y) for y in (*range(10), 45)], "img int, x int, y int")
    chosen = mainaxis.select_routes(nodes, points, previous, None, ["img"])
    assert sorted(r.seg for r in chosen.collect()) == [1, 3, 4, 6]


def test_distance_to_segments_of_any_length(spark):
    rng = random.Random(3)
    spots = {(g, s): {(rng.randint(0, 40 * s), rng.randint(0, 30 * s)) for _ in range(9 * s)} for g in (0, 1) for s in range(1, 9)}
    pixels = {(g, rng.randint(-50, 300), rng.randint(-50, 300)) for g in (0, 1, 2) for _ in range(30)}
    points = spark.createDataFrame([(g, s, x, y) for (g, s), at in spots.items() for x, y in at], "img int, seg long, x int, y int")
    asked = spark.createDataFrame([(g, s) for g in (0, 1) for s in range(2, 10)], "img int, seg long")
    got = mainaxis.segment_distance(asked, points, spark.createDataFrame(list(pixels), "img int, x int, y int"), ["img"]).collect()
    want = {(g, s, x, y): min((px - x) ** 2 + (py - y) ** 2 for px, py in at) for (g, s), at in spots.items() if s > 1 for k, x, y in pixels if k == g}
    assert len(got) == len(want) and {(r.img, r.seg, r.hx, r.hy): r.d2 for r in got} == want


def test_tile_filters_are_dealt_to_all_tasks(spark):
    px = spark.createDataFrame([(str(k), k, k % 3, 9 + k) for k in range(16)], "image_id string, x int, y int, v int")
    blocks = tiles.pixels_to_tiles(px, ["v"], 20, 12, 16)
    same = tiles.filter_tiles(blocks, 2, lambda block, radius: block[radius:-radius, radius:-radius], 16)
    assert blocks.rdd.getNumPartitions() > 1 and same.rdd.getNumPartitions() > 1
    assert same.count() == 32 and set(map(tuple, tiles.tile_pixels(same, ["v"]).collect())) == set(map(tuple, px.collect()))


def test_grey_tiles_are_worked_out_once(spark, capsys):
    prepared.prepared_pixels(spark, "/root/testdata/sf0.001").explain()
    assert "FlatMapGroups" not in capsys.readouterr().out


def test_median_of_levels_in_several_blocks():
    channel = np.random.default_rng(1).integers(0, 256, (84, 90)).astype(np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(channel, (5, 5))
    assert 2**20 // channel.size < len(np.unique(channel)) and np.array_equal(tiles._median(channel, 2), np.median(windows, axis=(-1, -2)))


def test_boxes_are_dealt_before_they_grow_to_pixels(spark, capsys):
    px = spark.createDataFrame([("a", x, y, 7 * x + y) for x in range(9) for y in range(8)], "image string, x int, y int, v int")
    boxes = spark.createDataFrame([("a", 5, 4, [1.0, 0.0, 2.0, 0.0, 1.0, 3.0])], "image string, out_w int, out_h int, to_source array<double>").coalesce(1)
    cropped = tiles.extract_pixels(px, boxes, "image", "v")
    assert set(map(tuple, cropped.collect())) == {("a", x, y, 7 * (x + 2) + y + 3) for x in range(5) for y in range(4)}
    cropped.explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out


def test_stems_of_images_are_clustered_by_all_tasks(spark, capsys):
    regions = spark.createDataFrame([(i, x, x + 2, 4, 6, 9) for i in range(9) for x in (30, 10, 20, 11)], "image int, min_x int, max_x int, min_y int, max_y int, area long")
    found = stems.cluster_stems(regions, ["image"], 3)
    assert {(r.image, r.slot, r.x) for r in found.collect()} == {(i, s, x) for i in range(9) for s, x in enumerate((12, 22, 32))}
    found.explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out


def test_pixels_of_boxes_and_marks_are_never_broadcast(spark, capsys):
    px = spark.createDataFrame([("a", x, y, 7 * x + y) for x in range(9) for y in range(8)], "image string, x int, y int, v int")
    boxes = spark.createDataFrame([("a", 5, 4, [1.0, 0.0, 2.0, 0.0, 1.0, 3.0])], "image string, out_w int, out_h int, to_source array<double>")
    tiles.extract_pixels(px, boxes, "image", "v").explain()
    luminance.erase_regions(px, px.where("x < 3"), ["image"], ["v"]).explain()
    assert "Broadcast" not in capsys.readouterr().out
