"""Bindings of the main-axis operators: portions, reconnected gaps and whole routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoframe.operators import mainaxis
from phenoframe.plans.registry import query, table
from phenoframe.plans.tracking import SERIES, event_series
from phenoframe.runtime import cut

PORTIONS = f"""{SERIES}, p AS (SELECT user_id, pos // 60 AS seg, pos % 60 AS pos, CAST(pos AS INTEGER) AS x, CAST(floor(value) AS INTEGER) % 2 AS y, 2 + pos % 3 AS width, floor(value) % 10 AS d, pos // 14 % 3 AS phase FROM ev),
m AS (SELECT DISTINCT user_id, x, y FROM p WHERE CASE phase WHEN 0 THEN d < 8 WHEN 1 THEN d < 2 ELSE d < 5 END),
l AS (SELECT DISTINCT user_id, x, y + 1 AS y FROM p WHERE CASE phase WHEN 0 THEN d > 8 ELSE d > 1 END),
n AS (SELECT p.user_id, seg, pos, x, y, width, EXISTS (SELECT 1 FROM m WHERE m.user_id = p.user_id AND (m.x - p.x) ** 2 + (m.y - p.y) ** 2 <= greatest(2.0, width * width / 4.0) + 1e-9) AS nm,
  EXISTS (SELECT 1 FROM l WHERE l.user_id = p.user_id AND (l.x - p.x) ** 2 + (l.y - p.y) ** 2 <= greatest(2.0, width * width / 4.0) + 1e-9) AS nl FROM p),
f AS (SELECT user_id, seg, pos, true AS main FROM n WHERE nm UNION ALL SELECT user_id, seg, pos, false FROM n WHERE nl AND NOT nm),
g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id, seg, main ORDER BY pos) AS run FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY user_id, seg, main ORDER BY pos) <= 3 THEN 0 ELSE 1 END AS brk FROM f)),
h AS (SELECT user_id, seg, main, min(pos) AS a, max(pos) AS b FROM g GROUP BY user_id, seg, main, run HAVING count(*) >= 5),
k AS (SELECT n.*, EXISTS (SELECT 1 FROM h WHERE h.user_id = n.user_id AND h.seg = n.seg AND main AND pos BETWEEN a AND b) AS ma,
  NOT nm AND EXISTS (SELECT 1 FROM h WHERE h.user_id = n.user_id AND h.seg = n.seg AND NOT main AND pos BETWEEN a AND b) AS sd FROM n),
z AS (SELECT *, count(*) OVER s AS n, count(*) FILTER (sd) OVER s AS ns, min(pos) FILTER (ma) OVER s AS fm, min(pos) FILTER (sd) OVER s AS fs FROM k WINDOW s AS (PARTITION BY user_id, seg)),
w AS (SELECT *, CASE WHEN ns = 0 THEN 'whole' WHEN fm IS NULL THEN CASE WHEN seg % 2 = 0 AND 2 * ns < n THEN 'whole' ELSE 'none' END WHEN fs < fm THEN 'parts' ELSE 'whole' END AS fate,
  sqrt(1 + (y - lag(y) OVER (PARTITION BY user_id, seg ORDER BY pos)) ** 2) AS st FROM z),
q AS (SELECT *, sum(coalesce(st, 0.0)) OVER (PARTITION BY user_id, seg ORDER BY pos) AS arc, CASE WHEN ma THEN true WHEN sd AND pos < fm THEN false END AS lab FROM w),
c AS (SELECT a.user_id, a.seg, a.pos, a.x, a.y, b.lab, row_number() OVER (PARTITION BY a.user_id, a.seg, a.pos ORDER BY abs(a.arc - b.arc), b.arc) AS rn
  FROM q a JOIN q b ON a.user_id = b.user_id AND a.seg = b.seg AND b.lab IS NOT NULL WHERE a.fate = 'parts')"""


@query("main_portions", f"""WITH {PORTIONS} SELECT user_id, seg, pos, x, y FROM q WHERE fate = 'whole' UNION ALL SELECT user_id, seg, pos, x, y FROM c WHERE rn = 1 AND lab""")
def main_portions(spark, folder):
    """Event series as segments of sixty points, with two histories that follow them in turns."""
    series = cut(event_series(spark, folder), "series")
    digit, phase = F.floor("value") % 10, F.floor(F.col("pos") / 14) % 3
    points = series.select(
        "user_id", F.floor(F.col("pos") / 60).alias("seg"), (F.col("pos") % 60).alias("pos"), F.col("pos").cast("int").alias("x"),
        (F.floor("value").cast("int") % 2).alias("y"), (2 + F.col("pos") % 3).alias("width"), digit.alias("d"), phase.alias("phase"))
    main = points.where("case phase when 0 then d < 8 when 1 then d < 2 else d < 5 end").select("user_id", "x", "y")
    side = points.where("case phase when 0 then d > 8 else d > 1 end").select("user_id", "x", (F.col("y") + 1).alias("y"))
    bridges = points.where("seg % 2 = 0").select("user_id", "seg").distinct()
    kept = mainaxis.main_portions(points.drop("d", "phase"), main, side, ["user_id"], bridges)
    return kept.select("user_id", "seg", "pos", "x", "y")


GAPS = """s AS (SELECT p_partkey % 11 AS img, p_partkey // 11 AS i, p_partkey AS seg, CAST(p_partkey * 13 % 200 AS INTEGER) AS ux, CAST(20 + p_partkey * 29 % 230 AS INTEGER) AS uy, CAST(p_partkey * 13 % 200 + p_size % 13 - 6 AS INTEGER) AS lx,
    CAST(20 + p_partkey * 29 % 230 + 8 + p_size % 20 AS INTEGER) AS ly, p_partkey % 4 = 0 AS joined FROM part),
n AS (SELECT s.*, CASE WHEN i % 3 = 0 THEN -1 - i % 6 WHEN EXISTS (SELECT 1 FROM s o WHERE o.seg = s.seg - 11) THEN seg - 11 END AS parent, lx - ux AS vx, ly - uy AS vy FROM s),
r AS (SELECT seg AS start, seg AS at, parent FROM n UNION ALL SELECT r.start, n.seg, n.parent FROM r JOIN n ON n.seg = r.parent),
pt AS (SELECT seg, k, CAST(floor(ux + vx * k / vy + 0.5) AS INTEGER) AS x, uy + k AS y FROM (SELECT *, unnest(range(0, vy + 1)) AS k FROM n)),
st AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + 1) AS dn, sqrt((x - lead(x) OVER w) ** 2 + 1) AS up FROM pt WINDOW w AS (PARTITION BY seg ORDER BY k)),
ar AS (SELECT seg, x, y, k, sum(coalesce(dn, 0.0)) OVER (PARTITION BY seg ORDER BY k) AS a, sum(coalesce(up, 0.0)) OVER (PARTITION BY seg ORDER BY k DESC) AS b FROM st),
ln AS (SELECT seg, max(a) AS len FROM ar GROUP BY 1),
pr AS (SELECT c.img, c.seg AS kid, t.seg AS tip, c.parent AS hook, c.ux - t.lx AS gx, c.uy - t.ly AS gy, sqrt((c.ux - t.lx) ** 2 + (c.uy - t.ly) ** 2) AS d, greatest(lc.len, lt.len) AS longest
  FROM n c JOIN n t ON c.img = t.img AND c.seg <> t.seg AND c.uy > t.ly JOIN ln lc ON lc.seg = c.seg JOIN ln lt ON lt.seg = t.seg
  WHERE c.parent IS NOT NULL AND NOT c.joined AND NOT EXISTS (SELECT 1 FROM n o WHERE o.parent = t.seg)),
dr AS (SELECT pr.*, (SELECT coalesce(arg_min(struct_pack(x := x, y := y), a) FILTER (a >= d), arg_max(struct_pack(x := x, y := y), a)) FROM ar WHERE ar.seg = kid) AS ck, (SELECT coalesce(arg_min(struct_pack(x := x, y := y), b) FILTER (b >= d), arg_max(struct_pack(x := x, y := y), b)) FROM ar WHERE ar.seg = tip) AS ct
  FROM pr WHERE d <= longest),
v AS (SELECT dr.*, ck.x - c.ux AS kx, ck.y - c.uy AS ky, t.lx - ct.x AS tx, t.ly - ct.y AS ty FROM dr JOIN n c ON c.seg = kid JOIN n t ON t.seg = tip),
ok AS (SELECT * FROM v WHERE gx * kx + gy * ky > abs(gx * ky - gy * kx) AND gx * tx + gy * ty > abs(gx * ty - gy * tx) AND EXISTS (SELECT 1 FROM r WHERE r.start = tip AND r.parent = hook)),
nk AS (SELECT kid, min(tip) AS tip FROM ok WHERE (kid, d) IN (SELECT (kid, min(d)) FROM ok GROUP BY kid) GROUP BY kid HAVING count(DISTINCT tip) = 1),
nt AS (SELECT tip, min(kid) AS kid FROM ok WHERE (tip, d) IN (SELECT (tip, min(d)) FROM ok GROUP BY tip) GROUP BY tip HAVING count(DISTINCT kid) = 1)"""


@query("fragment_reconnection", f"WITH RECURSIVE {GAPS} SELECT n.img, nk.kid AS seg, nk.tip AS parent FROM nk JOIN nt ON nk.kid = nt.kid AND nk.tip = nt.tip JOIN n ON n.seg = nk.kid")
def fragment_reconnection(spark, folder):
    """Parts as slanted strokes in chains of three; every fourth begins at a junction."""
    key = F.col("p_partkey")
    rows = table(spark, folder, "part").select(
        (key % 11).alias("img"), F.floor(key / 11).alias("i"), key.alias("seg"), (key * 13 % 200).cast("int").alias("upper_x"),
        (20 + key * 29 % 230).cast("int").alias("upper_y"), (key * 13 % 200 + F.col("p_size") % 13 - 6).cast("int").alias("lower_x"),
        (20 + key * 29 % 230 + 8 + F.col("p_size") % 20).cast("int").alias("lower_y"), F.when(key % 4 == 0, key).alias("upper_junction"))
    known = rows.select((F.col("seg") + 11).alias("seg"), F.lit(True).alias("_known"))
    nodes = cut(rows.join(known, "seg", "left").withColumn(
        "parent", F.when(F.col("i") % 3 == 0, -1 - F.col("i") % 6).when(F.col("_known"), F.col("seg") - 11)).drop("_known", "i"), "nodes")
    return mainaxis.forward_gaps(nodes, strokes(nodes), ["img"]).select("img", "seg", "parent")


def strokes(nodes):
    """The pixels of straight segments, one for each row they cross."""
    steps = nodes.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("lower_y") - F.col("upper_y"))))
    slope = (F.col("lower_x") - F.col("upper_x")) * F.col("pos") / (F.col("lower_y") - F.col("upper_y"))
    return steps.select("img", "seg", "pos", F.floor(F.col("upper_x") + slope + 0.5).cast("int").alias("x"), (F.col("upper_y") + F.col("pos")).alias("y"))


LEVELS = 9
_ROUTES = """s AS (SELECT p_partkey % 20 AS img, p_partkey // 20 AS i, p_partkey AS seg, p_size FROM part),
t AS (SELECT *, CASE WHEN i > 0 AND EXISTS (SELECT 1 FROM s o WHERE o.img = s.img AND o.i = (s.i - 1) // 3) THEN (i - 1) // 3 * 20 + img END AS parent, (SELECT count(*) FROM range(1, 12) l(l) WHERE (3 ** l - 1) / 2 <= s.i) AS lev FROM s),
n AS (SELECT img, i, seg, parent, lev, CAST(i * 37 % 160 AS INTEGER) AS x, CAST(30 * lev AS INTEGER) AS uy, CAST(30 * lev + 20 + p_size % 8 AS INTEGER) AS ly,
  CASE WHEN i % 4 = 1 THEN 1000000 + i WHEN i > 0 THEN (i - 1) // 3 // 2 * 2 END AS uj, i // 2 * 2 AS lj, p_size % 3 AS comp FROM t),
pt AS (SELECT img, seg, x, unnest(range(uy, ly + 1)) AS y FROM n),
hi AS (SELECT DISTINCT img, x + 1 AS x, uy + 3 AS y FROM n WHERE i % 7 IN (0, 3) AND lev < 4),
hp AS (SELECT hi.img, hi.x, hi.y, pt.seg, row_number() OVER (PARTITION BY hi.img, hi.x, hi.y ORDER BY (pt.x - hi.x) ** 2 + (pt.y - hi.y) ** 2, pt.y, pt.x, pt.seg) AS rn, (pt.x - hi.x) ** 2 + (pt.y - hi.y) ** 2 AS d2
  FROM hi JOIN pt ON pt.img = hi.img AND abs(pt.x - hi.x) <= 2 AND abs(pt.y - hi.y) <= 2 AND (pt.x - hi.x) ** 2 + (pt.y - hi.y) ** 2 <= 4),
vo AS (SELECT seg, count(*) AS v FROM hp WHERE rn = 1 AND d2 <= 4 GROUP BY 1),
ne AS (SELECT DISTINCT seg FROM hp),
a AS (SELECT n.*, coalesce(v, 0) AS v, (ne.seg IS NOT NULL)::INT AS near FROM n LEFT JOIN vo USING (seg) LEFT JOIN ne USING (seg)),
c AS (SELECT seg, img, lev, v, near, parent AS cand, true AS base FROM a WHERE parent IS NOT NULL
  UNION ALL SELECT a.seg, a.img, a.lev, a.v, a.near, b.seg, false FROM a JOIN a b ON a.img = b.img AND b.lj = a.uj AND b.seg <> a.seg AND b.ly <= a.uy AND b.seg IS DISTINCT FROM a.parent WHERE a.img IN (SELECT img FROM a WHERE v > 0)),
cp AS (SELECT c.*, x.uj = y.lj OR x.comp = y.comp AS phys FROM c JOIN a x ON x.seg = c.seg JOIN a y ON y.seg = c.cand),
r0 AS (SELECT seg, img, [seg] AS path, v AS score, near AS nearby FROM a WHERE lev = 0)"""


def _level(k):
    off = """(SELECT round(avg(m), 6) FROM (SELECT min(sqrt((h.x - q.x) ** 2 + (h.y - q.y) ** 2)) AS m FROM hi h JOIN pt q ON q.img = h.img WHERE h.img = {0}.img AND list_contains({1}, q.seg) GROUP BY h.x, h.y))"""
    return f""", o{k} AS (SELECT cp.*, r{k - 1}.path, r{k - 1}.score, r{k - 1}.nearby, CASE WHEN cp.v + r{k - 1}.score > 0 THEN {off.format('cp', f'list_append(r{k - 1}.path, cp.seg)')} END AS off FROM cp JOIN r{k - 1} ON r{k - 1}.seg = cp.cand WHERE cp.lev = {k}),
b{k} AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY off IS NULL, off, phys DESC, base DESC, cand) AS rn FROM o{k}),
r{k} AS (SELECT * FROM r{k - 1} UNION ALL SELECT a.seg, a.img, CASE WHEN b.seg IS NULL OR (a.v > 0 AND b.score = 0 AND b.nearby = 0 AND NOT b.phys) THEN [a.seg] ELSE list_append(b.path, a.seg) END,
  a.v + coalesce(b.score, 0), greatest(a.near, coalesce(b.nearby, 0)) FROM a LEFT JOIN b{k} b ON b.seg = a.seg AND b.rn = 1 WHERE a.lev = {k})"""


MAIN = f"""WITH {_ROUTES}{''.join(_level(k) for k in range(1, LEVELS))},
r AS (SELECT r{LEVELS - 1}.*, a.ly, a.x FROM r{LEVELS - 1} JOIN a USING (seg)),
tip AS (SELECT r.*, (SELECT round(avg(m), 6) FROM (SELECT min(sqrt((h.x - q.x) ** 2 + (h.y - q.y) ** 2)) AS m FROM hi h JOIN pt q ON q.img = h.img WHERE h.img = r.img AND list_contains(r.path, q.seg) GROUP BY h.x, h.y)) AS off
  FROM r WHERE NOT EXISTS (SELECT 1 FROM cp WHERE cp.cand = r.seg)),
one AS (SELECT * FROM tip QUALIFY row_number() OVER (PARTITION BY img ORDER BY score DESC, ly DESC, x, seg) = 1),
fl AS (SELECT img, max(y) AS fy FROM hi WHERE y % 2 = 0 OR img % 3 = 0 GROUP BY 1),
two AS (SELECT t.* FROM tip t JOIN one o ON o.img = t.img JOIN fl ON fl.img = t.img WHERE o.ly < fy AND t.ly >= fy AND t.score > 0 AND t.seg <> o.seg QUALIFY row_number() OVER (PARTITION BY t.img ORDER BY t.off, t.ly DESC, t.x, t.seg) = 1),
fin AS (SELECT CASE WHEN two.seg IS NOT NULL AND (one.score = 0 OR two.off < one.off) THEN two.seg ELSE one.seg END AS seg FROM one LEFT JOIN two USING (img))
SELECT r.img, r.seg AS tip, unnest(r.path) AS seg FROM r JOIN fin ON fin.seg = r.seg"""


@query("main_axis", MAIN)
def main_axis(spark, folder):
    """Parts as vertical strokes of a three-way tree in which neighbours share the junctions at their lower ends."""
    key = F.col("p_partkey")
    rows = table(spark, folder, "part").select((key % 20).alias("img"), F.floor(key / 20).alias("i"), key.alias("seg"), "p_size")
    i = F.col("i")
    level = F.size(F.filter(F.sequence(F.lit(1), F.lit(11)), lambda k: (F.pow(F.lit(3.0), k) - 1) / 2 <= i))
    above = F.floor((i - 1) / 3)
    shaped = rows.select(
        "img", "seg", "i", level.alias("lev"), F.when(i > 0, above * 20 + F.col("img")).alias("_up"), (i * 37 % 160).cast("int").alias("x"),
        F.when(i % 4 == 1, 1000000 + i).when(i > 0, F.floor(above / 2) * 2).alias("upper_junction"), (F.floor(i / 2) * 2).alias("lower_junction"),
        (F.col("p_size") % 3).cast("long").alias("component"), (F.col("p_size") % 8).alias("extra"))
    known = rows.select("img", F.col("seg").alias("_up"), F.lit(True).alias("_known"))
    nodes = cut(shaped.join(known, ["img", "_up"], "left").select(
        "img", "seg", "i", "lev", F.when(F.col("_known"), F.col("_up")).alias("parent"), F.col("x").alias("upper_x"), (30 * F.col("lev")).cast("int").alias("upper_y"),
        F.col("x").alias("lower_x"), (30 * F.col("lev") + 20 + F.col("extra")).cast("int").alias("lower_y"), "upper_junction", "lower_junction", "component"), "nodes")
    points = cut(strokes(nodes).withColumn("width", F.lit(4.0)), "points")
    previous = nodes.where("i % 7 in (0, 3) and lev < 4").select("img", (F.col("upper_x") + 1).alias("x"), (F.col("upper_y") + 3).alias("y")).distinct()
    votes = mainaxis.history_votes(points, previous, ["img"])
    near = mainaxis.nearest_within(points, previous, 2, ["img"]).where("d2 is not null").select("img", "seg", F.lit(1).alias("near")).distinct()
    judged = nodes.join(votes, ["img", "seg"], "left").join(near, ["img", "seg"], "left").na.fill(0, ["votes", "near"]).withColumn("unsure", F.lit(0))
    recent = previous.where("y % 2 = 0 or img % 3 = 0")
    return mainaxis.select_routes(judged, points, previous, recent, ["img"]).select("img", "tip", "seg")
