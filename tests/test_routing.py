"""Routing scenes: evidence for sharing a corridor, crossings, contractions and arrivals that wait for each other."""

import math

from phenoframe.operators import linking

SEGMENT = ("g string, seg long, upper_x int, upper_y int, lower_x int, lower_y int, upper_angle double, lower_angle double, "
           "upper_junction long, lower_junction long")


def heading(a, b):
    return math.degrees(math.atan2(b[1] - a[1], b[0] - a[0])) % 360


def walk(ends):
    rows = []
    for (x0, y0), (x1, y1) in zip(ends, ends[1:]):
        n = max(abs(x1 - x0), abs(y1 - y0), 1)
        rows += [(round(x0 + (x1 - x0) * k / n), round(y0 + (y1 - y0) * k / n)) for k in range(n)]
    return rows + [ends[-1]]


def routed(spark, scenes, support=(), measured=True):
    """{scene: {seg: {owner: until}}} of scenes {name: [(seg, corners, width, upper, lower, base)]}; owner 0 has x = 20, 1 has x = 40."""
    segments, points, base = [], [], []
    for name, rows in scenes.items():
        for seg, corners, width, upper, lower, parent in rows:
            path = walk(corners)
            segments.append((name, seg, *corners[0], *corners[-1], heading(corners[1], corners[0]), heading(corners[-2], corners[-1]), upper, lower))
            points += [(name, seg, k, x, y, float(width(k) if callable(width) else width)) for k, (x, y) in enumerate(path)]
            if parent is not None:
                base.append((name, seg, parent, *corners[0]))
    table = spark.createDataFrame(segments, SEGMENT)
    stems = spark.createDataFrame([(n, o, x, 0) for n in scenes for o, x in ((0, 20), (1, 40))], "g string, owner int, x int, y int")
    links = spark.createDataFrame(base, "g string, seg long, parent long, parent_x int, parent_y int")
    before = spark.createDataFrame(list(support), "g string, seg long, support_owner int, share double")
    pts = spark.createDataFrame(points, "g string, seg long, pos long, x int, y int, width double") if measured else None
    flows = linking.route(table, links, stems, before, ["g"], pts).collect()
    out = {name: {} for name in scenes}
    for r in flows:
        out[r.g].setdefault(r.seg, {})[r.owner] = r.until
    return out


LEFT = (1, [(20, 2), (28, 40)], 5, None, 7, -1)
RIGHT = (2, [(40, 2), (32, 40)], 5, None, 7, -2)


def test_sharing_needs_evidence(spark):
    def lane(width, corners=((30, 42), (30, 100)), lower=None):
        return (3, list(corners), width, 7, lower, None)

    def scaled(width):
        return [(s, [(2 * x, 2 * y) for x, y in c], 2 * w, u, d, b) for s, c, w, u, d, b in (LEFT, RIGHT, lane(width))]

    exits = [(4, [(28, 52), (10, 100)], 5, 8, None, None), (5, [(32, 52), (50, 100)], 5, 8, None, None)]
    short = lane(5, ((30, 42), (30, 50)), 8)
    scenes = {
        "one": [LEFT, RIGHT, lane(5)],
        "both": [LEFT, RIGHT, lane(9)],
        "both, twice as large": scaled(9),
        # The right root's side of the bundle goes on after the narrowing at point 30.
        "ends": [LEFT, RIGHT, lane(lambda k: 9 if k < 30 else 5, ((30, 42), (30, 71), (32, 72), (32, 110)))],
        # Each root has an exit of its own behind a corridor of single width.
        "crossing": [LEFT, RIGHT, short, *exits],
        "crossing, split corridor": [LEFT, RIGHT, lane(5, ((30, 42), (30, 46)), 9), (6, [(30, 47), (30, 50)], 5, 9, 8, None), *exits],
        "side root": [LEFT, RIGHT, short, exits[0], (5, [(29, 52), (12, 90)], 5, 8, None, None)],
    }
    got = routed(spark, scenes)
    assert len(got["one"][3]) == 1
    assert set(got["both"][3]) == {0, 1} and set(got["both, twice as large"][3]) == {0, 1}
    ends = got["ends"][3]
    assert ends[1] is None and 26 <= ends[0] <= 34
    for name in ("crossing", "crossing, split corridor"):
        assert set(got[name][3]) == {0, 1} and set(got[name][4]) == {1} and set(got[name][5]) == {0}, name
    assert set(got["crossing, split corridor"][6]) == {0, 1}
    assert len(got["side root"][3]) == 1 and set(got["side root"][4]) == set(got["side root"][5]) == set(got["side root"][3])


def test_without_widths_owners_share(spark):
    got = routed(spark, {"plain": [LEFT, RIGHT, (3, [(30, 42), (30, 100)], 5, 7, None, None)]}, measured=False)
    assert set(got["plain"][3]) == {0, 1}


def test_lone_exit_goes_to_the_straightest_arrival(spark):
    # The right root's last pixels bend towards the contact; over its whole arm it leads on.
    bent = (2, [(60, 2), (36, 50), (31, 52)], 5, None, 7, -2)
    left = (1, [(20, 2), (20, 44), (29, 52)], 5, None, 7, -1)
    got = routed(spark, {"bent": [left, bent, (3, [(30, 54), (10, 94)], 5, 7, None, None)]})
    assert set(got["bent"][3]) == {1}


def test_waiting_arrivals_are_released_upstream_first(spark):
    # Junctions 1 and 2 wait for each other, 3 and 4 wait for each other and for 2; the lower pair lies higher up.
    scene = [
        (1, [(20, 30), (20, 40)], 5, 1, 2, -1), (2, [(20, 41), (22, 45)], 5, 2, 1, 1), (3, [(22, 41), (24, 50)], 5, 2, 3, None),
        (4, [(40, 4), (40, 10)], 5, 3, 4, 3), (5, [(40, 11), (42, 20)], 5, 4, 3, 4), (6, [(80, 11), (82, 20)], 5, None, None, None),
    ]
    lone = [(1, [(20, 30), (20, 40)], 5, 1, 2, None), (2, [(20, 41), (22, 45)], 5, 2, 1, 1)]
    got = routed(spark, {"waits": scene, "rootless": lone, "plain": [LEFT]})
    assert {s: set(o) for s, o in got["waits"].items()} == {k: {0} for k in range(1, 6)}
    assert got["rootless"] == {} and set(got["plain"][1]) == {0}


def test_established_owners_stay(spark):
    # The corridor was the left root's; the right one merely touches it, though the width would fit one root only.
    got = routed(spark, {"held": [LEFT, RIGHT, (3, [(30, 42), (30, 100)], 5, 7, None, None)]}, [("held", 3, 0, 0.9)])
    assert set(got["held"][3]) == {0}
