"""Region sizes, plate bounds, first occurrences and upward tips on scenes with known answers."""

from phenoframe.operators import orientation, regions


def rectangle(label, x0, y0, x1, y1, image=1):
    return [(image, label, x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]


def test_regions_by_boundary_and_area(spark):
    rows = rectangle(1, 5, 7, 24, 16) + rectangle(2, 40, 3, 40, 60) + rectangle(3, 50, 50, 51, 51) + rectangle(4, 0, 0, 0, 0, 2)
    frame = spark.createDataFrame(rows + rows[:9], "image int, label int, x int, y int").repartition(7)
    got = {(r.image, r.label): r for r in regions.region_filter(frame, ["image"], 20, 50.0).collect()}
    # A rectangle's polygon of pixel centres is one pixel smaller each way, a line's has no area; the rim is the boundary.
    assert (got[1, 1].area, got[1, 1].boundary, got[1, 1].enclosed, got[1, 1].reason) == (200, 56, 19 * 9, None)
    assert (got[1, 2].boundary, got[1, 2].enclosed, got[1, 2].reason) == (58, 0.0, "area")
    assert got[1, 3].reason == got[2, 4].reason == "boundary"
    images = spark.createDataFrame([(1, 80, 70), (2, 30, 20), (3, 9, 8)], "image int, width int, height int")
    table = regions.region_filter(frame, ["image"], 20, 50.0)
    assert {(r.image, r.top) for r in regions.top_edge(table, images, ["image"]).collect()} == {(1, 7), (2, 0), (3, 0)}
    largest = {r.image: (r.x, r.y, r.width, r.height) for r in regions.plate_bounds(table, images, ["image"]).collect()}
    assert largest == {1: (5, 7, 20, 10), 2: (0, 0, 30, 20), 3: (0, 0, 9, 8)}
    union = {r.image: (r.x, r.y, r.width, r.height) for r in regions.plate_bounds(table, images, ["image"], True, 0.5).collect()}
    assert union[1] == (5, 7, 47, 45)
    assert regions.region_filter(frame.limit(0), ["image"], 1, 1.0).count() == 0


def test_first_occurrences(spark):
    rows = spark.createDataFrame([(1, "a", 3, "x"), (1, "a", 1, "y"), (1, "b", 9, None), (2, "a", 4, "z"), (None, "a", 0, "n")], "k int, t string, o int, v string")
    got = {tuple(r) for r in regions.first_occurrences(rows, ["k", "t"], ["o"]).collect()}
    assert got == {(1, "a", 1, "y"), (1, "b", 9, None), (2, "a", 4, "z"), (None, "a", 0, "n")}


def test_upward_tips(spark):
    columns = "g string, seg long, upper_x int, upper_y int, lower_x int, lower_y int, upper_angle double, lower_angle double, upper_junction long, lower_junction long, length double"
    rooted = (1, 50, 0, 50, 60, 270.0, 90.0, None, 5, 60.0)
    tip = (2, 80, 30, 52, 61, 300.0, 120.0, None, 5, 42.0)
    def scene(name, *rows):
        return [(name, *r) for r in rows]

    rows = (
        scene("turned", rooted, tip, (3, 53, 63, 60, 99, 270.0, 90.0, None, None, 36.0)) + scene("near gap", rooted, tip) + scene("on a stem", rooted, tip)
        + scene("held", rooted, tip) + scene("own descendant", tip, (4, 60, 40, 51, 60, 280.0, 100.0, None, 5, 22.0)) + scene("unowned", rooted, tip))
    segments = spark.createDataFrame(rows, columns)
    far, near = (2, 1, 300, 300), (2, 1, 80, 20)
    links = [("turned", *far), ("turned", 3, 2, 52, 61), ("near gap", *near), ("on a stem", 2, -1, 300, 300), ("held", *far), ("own descendant", *far), ("own descendant", 4, 2, 52, 61), ("unowned", *far)]
    links = spark.createDataFrame(links + [(n, 1, -1, 50, 0) for n in ("turned", "near gap", "on a stem", "held", "unowned")], "g string, seg long, parent long, parent_x int, parent_y int")
    owned = segments.where("not (g = 'unowned' and seg = 1)").select("g", "seg")
    held = spark.createDataFrame([("held", 2)], "g string, seg long")
    turned = orientation.upward_tips(segments, links, owned, held, ["g"])
    assert {(r.g, r.seg, r.anchor) for r in turned.collect()} == {("turned", 2, 1)}
    after = {r.seg: r for r in orientation.turned_segments(segments, turned, ["g"]).where("g = 'turned'").collect()}
    assert (after[2].upper_x, after[2].upper_y, after[2].lower_x, after[2].upper_angle, after[2].upper_junction, after[2].lower_junction) == (52, 61, 80, 120.0, 5, None)
    assert (after[1].upper_x, after[1].lower_junction) == (50, 5)
    kept = {(r.seg, r.parent, r.parent_x, r.parent_y) for r in orientation.turned_links(links, turned, segments, ["g"]).where("g = 'turned'").collect()}
    assert kept == {(1, -1, 50, 0), (3, 1, 50, 60)}
