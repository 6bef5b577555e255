"""Bindings of the contact evidence: width tests, independent exits and carried sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoframe.operators import contacts
from phenoframe.plans.registry import query, table
from phenoframe.plans.tracking import SERIES, event_series
from phenoframe.runtime import cut

CORRIDORS = f"""{SERIES}, p AS (SELECT user_id, pos // 48 AS seg, pos % 48 AS k, (user_id + pos // 48) % 5 AS kind, value FROM ev),
g AS (SELECT user_id, seg, k, k AS x, CASE WHEN k < 30 THEN 0 ELSE (user_id % 3 - 1) * 2 END AS y, floor(value) % 2 * 0.5 + CASE kind WHEN 0 THEN 11.0 WHEN 1 THEN 5.0 WHEN 2 THEN CASE WHEN k < 30 THEN 11.0 ELSE 5.0 END
  WHEN 3 THEN CASE WHEN k < 33 THEN 10.5 ELSE 6.0 END ELSE 7.5 END AS w FROM p),
l AS (SELECT user_id, seg, list(w ORDER BY k) AS w, list(x ORDER BY k) AS x, list(y ORDER BY k) AS y, count(*)::INT AS n FROM g GROUP BY 1, 2),
o AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 6.0 ELSE 5.0 END AS w1, seg % 2 AS winner, user_id % 3 = 0 AS inh,
  CASE WHEN n > 1 THEN list_aggregate(list_transform(range(1, n), lambda i: sqrt((x[i + 1] - x[i]) ** 2 + (y[i + 1] - y[i]) ** 2)), 'median') ELSE 1.0 END AS sp FROM l),
a AS (SELECT *, 8.5 + w1 / 2 AS bundle, w1 AS widest, CASE WHEN winner = 0 THEN 5.0 ELSE w1 END AS single, greatest(1, round_even(w1 / sp, 0))::INT AS r FROM o),
m AS (SELECT *, list_transform(range(0, n), lambda i: list_aggregate(list_transform(range(i - r, i + r + 1), lambda j: w[greatest(0, least(j, n - 1)) + 1]), 'median')) AS m FROM a),
f AS (SELECT *, CASE WHEN inh AND n < 2 * r THEN m[1:r] ELSE m[r + 1:2 * r] END AS first FROM m),
s AS (SELECT *, list_aggregate(m[greatest(n - greatest(r, n // 4), 0) + 1:n], 'median') AS tail FROM f WHERE len(first) >= r
  AND list_aggregate(list_transform(first, lambda v: abs(v - bundle)), 'median') < list_aggregate(list_transform(first, lambda v: greatest(0.0, abs(v - single) - sp)), 'median')),
b AS (SELECT *, least(abs(5.0 - tail), abs(w1 - tail)) AS best FROM s),
c AS (SELECT *, abs(abs(5.0 - tail) - best) <= 1e-8 + 1e-5 * best AS c0, abs(abs(w1 - tail) - best) <= 1e-8 + 1e-5 * best AS c1 FROM b),
d AS (SELECT *, CASE WHEN c0 THEN 5.0 ELSE w1 END AS cal FROM c),
e AS (SELECT *, CASE WHEN best < abs(tail - bundle) THEN list_filter(range(2 * r, n - r), lambda i: len(list_filter(m[i + 1:i + r], lambda v: abs(v - cal) >= abs(v - bundle))) = 0)[1] END AS ctr FROM d),
h AS (SELECT *, x[greatest(0, ctr - 2 * r) + 1:ctr] AS xb, y[greatest(0, ctr - 2 * r) + 1:ctr] AS yb, x[ctr + 1:ctr + 2 * r] AS xa, y[ctr + 1:ctr + 2 * r] AS ya FROM e),
k AS (SELECT *, (list_avg(ya) - list_avg(yb)) * (xb[-1] - xb[1]) / sqrt((xb[-1] - xb[1]) ** 2 + (yb[-1] - yb[1]) ** 2) - (list_avg(xa) - list_avg(xb)) * (yb[-1] - yb[1]) / sqrt((xb[-1] - xb[1]) ** 2 + (yb[-1] - yb[1]) ** 2) AS shift FROM h),
z AS (SELECT *, CASE WHEN ctr IS NULL THEN NULL WHEN c0 <> c1 THEN CASE WHEN c0 THEN 0 ELSE 1 END WHEN len(xa) >= 2 AND abs(shift) >= sp THEN CASE WHEN shift * 3 > shift * -3 THEN 1 ELSE 0 END END AS surv FROM k)"""


@query("width_support", f"WITH {CORRIDORS} SELECT user_id, seg, CAST(CASE WHEN surv IS NULL THEN n ELSE ctr END AS INTEGER) AS cut, CAST(coalesce(surv, winner) AS INTEGER) AS survivor FROM z")
def width_support(spark, folder):
    """Event series as corridors of 48 points: bundles, single roots, contractions at two places and in-between widths."""
    series = event_series(spark, folder)
    k, kind = F.col("pos") % 48, (F.col("user_id") + F.floor(F.col("pos") / 48)) % 5
    base = (
        F.when(kind == 0, 11.0).when(kind == 1, 5.0).when(kind == 2, F.when(k < 30, 11.0).otherwise(5.0))
        .when(kind == 3, F.when(k < 33, 10.5).otherwise(6.0)).otherwise(7.5))
    points = series.select(
        "user_id", F.floor(F.col("pos") / 48).alias("seg"), k.alias("pos"), k.cast("int").alias("x"),
        F.when(k < 30, 0).otherwise((F.col("user_id") % 3 - 1) * 2).cast("int").alias("y"), (base + F.floor("value") % 2 * 0.5).alias("width"))
    thick = F.when(F.col("user_id") % 2 == 0, 6.0).otherwise(5.0)
    options = F.array(*[
        F.struct(F.lit(i).alias("owner"), w.alias("width"), F.lit(center).alias("center")) for i, w, center in ((0, F.lit(5.0), -3.0), (1, thick, 3.0))])
    corridors = contacts.profiles(points, ["user_id"]).select(
        "user_id", "seg", "path", "widths", F.col("widths").alias("measured"), options.alias("options"), (F.col("seg") % 2).cast("int").alias("winner"),
        (F.col("user_id") % 3 == 0).alias("inherited"))
    return contacts.width_support(corridors, ["user_id"])


EXITS = """s AS (SELECT p_partkey % 13 AS img, p_partkey // 13 AS i, p_partkey AS seg, p_size AS z, p_partkey AS key FROM part),
n AS (SELECT *, CASE WHEN i % 3 = 0 THEN i ELSE i // 6 * 6 + 1 END AS lj, CASE WHEN i % 3 = 1 THEN i - 1 ELSE i * 7 % 90 // 6 * 6 + 1 END AS uj, z * 37 % 360 + 0.5 AS ua, z * 53 % 360 + 0.25 AS la, key * 3 % 50 AS ux, key * 5 % 40 AS uy, key * 7 % 50 AS lx, key * 11 % 40 AS ly, 5.0 + z AS len FROM s),
ld AS (SELECT a.img, a.lj AS j, a.n AS nin, b.n AS nout FROM (SELECT img, lj, count(*) AS n FROM n GROUP BY 1, 2) a JOIN (SELECT img, uj, count(*) AS n FROM n GROUP BY 1, 2) b ON a.img = b.img AND a.lj = b.uj),
nx AS (SELECT n.seg, c.seg AS nxt, sqrt((c.ux - n.lx) ** 2 + (c.uy - n.ly) ** 2) AS gap FROM n JOIN ld ON ld.img = n.img AND ld.j = n.lj AND nin = 1 AND nout = 1 JOIN n c ON c.img = n.img AND c.uj = n.lj),
w AS (SELECT seg AS start, seg AS cur, len AS dist FROM n UNION ALL SELECT w.start, nx.nxt, w.dist + nx.gap + n.len FROM w JOIN nx ON nx.seg = w.cur JOIN n ON n.seg = nx.nxt),
far AS (SELECT start AS seg, cur, dist, n.img, n.lj AS j FROM w JOIN n ON n.seg = w.cur JOIN ld ON ld.img = n.img AND ld.j = n.lj AND nout >= 2 WHERE cur NOT IN (SELECT seg FROM nx)),
op AS (SELECT img, seg, o.o AS owner, CASE WHEN o.o = 0 THEN key * 7 % 180 ELSE key * 11 % 180 + 0.5 END AS angle, CASE WHEN key % 7 = o.o THEN NULL ELSE 2.0 + (z + o.o) % 5 END AS width FROM n, range(0, 2) o(o) WHERE i % 2 = 0),
en AS (SELECT op.seg, far.img, far.j, owner, angle FROM op JOIN far USING (seg) UNION ALL SELECT far.seg, far.img, far.j, NULL, n.la FROM far JOIN n ON n.img = far.img AND n.lj = far.j AND n.seg <> far.cur WHERE far.seg IN (SELECT seg FROM op)),
sc AS (SELECT en.*, c.seg AS child, abs(((angle - (c.ua + 180) + 180) % 360 + 360) % 360 - 180) AS t FROM en JOIN n c ON c.img = en.img AND c.uj = en.j),
be AS (SELECT seg, child, min(t) AS t FROM sc GROUP BY 1, 2),
wo AS (SELECT sc.seg, sc.child, min(owner) AS owner FROM sc JOIN be USING (seg, child) WHERE abs(sc.t - be.t) <= 1e-8 + 1e-5 * be.t AND be.t < 90 GROUP BY 1, 2 HAVING count(*) = 1 AND min(owner) IS NOT NULL),
pa AS (SELECT seg, count(width) AS nw, sum(width) AS wsum, abs(((min(angle) - max(angle) + 180) % 360 + 360) % 360 - 180) AS ap FROM op GROUP BY 1),
li AS (SELECT seg, CASE WHEN nw = 2 AND ap > 0 THEN wsum / sin(radians(ap / 2)) ELSE 0 END AS lim FROM pa),
hs AS (SELECT seg, i // 4 % 2 AS old FROM n WHERE i % 4 = 0)"""


@query("independent_exits", f"""WITH RECURSIVE {EXITS} SELECT DISTINCT far.img, wo.seg, CAST(owner AS INTEGER) AS owner FROM wo JOIN far USING (seg) JOIN li USING (seg) LEFT JOIN hs hc ON hc.seg = wo.child LEFT JOIN hs ho ON ho.seg = wo.seg
WHERE (hc.old IS NULL OR hc.old = owner) AND NOT (ho.old IS NOT NULL AND ho.old <> owner AND hc.old IS NULL AND dist > lim)""")
def independent_exits(spark, folder):
    """Parts as segments between junctions of one arrival or of several."""
    key, z = F.col("p_partkey"), F.col("p_size")
    i = F.floor(key / 13)
    lower = F.when(i % 3 == 0, i).otherwise(F.floor(i / 6) * 6 + 1)
    upper = F.when(i % 3 == 1, i - 1).otherwise(F.floor(i * 7 % 90 / 6) * 6 + 1)
    place = {"upper_x": key * 3 % 50, "upper_y": key * 5 % 40, "lower_x": key * 7 % 50, "lower_y": key * 11 % 40}
    segments = cut(table(spark, folder, "part").select(
        (key % 13).alias("img"), key.alias("seg"), i.alias("i"), z.alias("z"), lower.alias("lower_junction"), upper.alias("upper_junction"),
        (z * 37 % 360 + 0.5).alias("upper_angle"), (z * 53 % 360 + 0.25).alias("lower_angle"), *[v.alias(n) for n, v in place.items()]), "segments")
    owner = F.col("owner")
    options = segments.where("i % 2 = 0").withColumn("owner", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "img", "seg", "owner", F.when(owner == 0, F.col("seg") * 7 % 180).otherwise(F.col("seg") * 11 % 180 + 0.5).cast("double").alias("angle"),
        F.lit(1).alias("routes"), F.when(F.col("seg") % 7 != owner, 2.0 + (F.col("z") + owner) % 5).alias("width"))
    lengths = segments.select("img", "seg", (5.0 + F.col("z")).alias("length"))
    history = segments.where("i % 4 = 0").select("img", "seg", (F.floor(F.col("i") / 4) % 2).cast("int").alias("owner"))
    return contacts.independent_exits(options, segments, lengths, history, ["img"])


CARRIED = """s AS (SELECT p_partkey % 13 AS img, p_partkey AS seg, p_size AS z, CAST(6 + p_size AS INTEGER) AS n FROM part),
pt AS (SELECT seg, k, k // 3 AS x, k AS y, 3.0 + (k + seg) % 4 + CASE WHEN seg % 3 = 0 THEN 5 ELSE 0 END AS w FROM (SELECT *, unnest(range(0, n)) AS k FROM s)),
pf AS (SELECT seg, list(w ORDER BY k) AS w, count(*) AS n, sum(st) AS len, coalesce(median(st), 1.0) AS sp FROM (SELECT *, sqrt(1 + (x - lag(x) OVER (PARTITION BY seg ORDER BY k)) ** 2) AS st FROM pt) WHERE seg % 17 <> 5 GROUP BY 1),
iw AS (SELECT *, list_aggregate(w[n // 4 + 1:greatest(n // 4 + 1, 3 * n // 4)], 'median') AS inner_w FROM pf),
ro AS (SELECT img, seg, o.o AS owner, seg + 13 * (1 + o.o) AS parent, seg * 3 % 40 + o.o * 6 AS px, seg * 5 % 40 AS py, CAST(60 + z + o.o * (seg % 60) AS DOUBLE) AS angle, z * 37 % 360 AS ua FROM s, range(0, 2) o(o) WHERE o.o = 0 OR seg % 2 = 0),
se AS (SELECT seg, o.o AS owner, 4.5 + o.o AS width, 1.0 - 2 * o.o AS off, seg % 10 = 0 AS par, 7.0 AS trav FROM s, range(0, 2) o(o) WHERE seg % 5 = 0),
ar AS (SELECT ro.*, coalesce(se.width, iw.inner_w) AS width, -sin(radians(ua + 180)) * px + cos(radians(ua + 180)) * py + coalesce(se.off, 0) AS center, (SELECT max(par::INT) FROM se e WHERE e.seg = ro.parent) AS par, (SELECT max(trav) FROM se e WHERE e.seg = ro.parent) AS trav
  FROM ro LEFT JOIN se ON se.seg = ro.parent AND se.owner = ro.owner LEFT JOIN iw ON iw.seg = ro.parent),
ar2 AS (SELECT *, CASE WHEN width IS NOT NULL THEN center END AS mid FROM ar),
fa AS (SELECT seg, count(*) AS m, count(width) AS known, min(mid - width / 2) AS lft, max(mid + width / 2) AS rgt, max(width) AS widest, sum(width) AS total, coalesce(max(par), 0) AS par, coalesce(max(trav), 0) AS trav, abs(((min(angle) - max(angle) + 180) % 360 + 360) % 360 - 180) AS ap FROM ar2 GROUP BY 1),
fb AS (SELECT fa.*, iw.w, iw.n, iw.len, iw.inner_w, greatest(1, round_even(widest / sp, 0))::INT AS win, rgt - lft - widest AS exc FROM fa JOIN iw USING (seg) WHERE m = 1 OR known = m),
fc AS (SELECT *, CASE WHEN exc > 0 AND n >= 2 * win THEN least(1, greatest(0, (list_aggregate(w[1:2 * win], 'median') - widest) / exc)) ELSE 1 END AS scale, len + trav AS go,
  m > 1 AND ((seg % 4 = 0 AND ap > 0 AND len + trav > total / sin(radians(ap / 2))) OR par = 1) AS parallel FROM fb)"""


@query("carried_widths", f"""WITH {CARRIED} SELECT ar2.img, ar2.seg, CAST(ar2.owner AS INTEGER) AS owner, round(CAST(CASE WHEN m = 1 THEN inner_w ELSE width END AS DOUBLE), 6) AS width, round(CAST(CASE WHEN m = 1 THEN 0 ELSE (mid - (lft + rgt) / 2) * scale END AS DOUBLE), 6) AS "offset",
  m > 1 AS bundle, parallel, round(CAST(CASE WHEN m > 1 THEN go ELSE 0 END AS DOUBLE), 6) AS travelled FROM ar2 JOIN fc USING (seg)""")
def carried_widths(spark, folder):
    """Parts as corridors that one or two roots enter from segments with sections, with a profile, or with neither."""
    key, z = F.col("p_partkey"), F.col("p_size")
    base = cut(table(spark, folder, "part").select((key % 13).alias("img"), key.alias("seg"), z.alias("z")), "base")
    steps = base.withColumn("pos", F.explode(F.sequence(F.lit(0), (5 + F.col("z")).cast("int"))))
    points = steps.where("seg % 17 <> 5").select(
        "img", "seg", "pos", F.floor(F.col("pos") / 3).cast("int").alias("x"), F.col("pos").alias("y"),
        (3.0 + (F.col("pos") + F.col("seg")) % 4 + F.when(F.col("seg") % 3 == 0, 5).otherwise(0)).alias("width"))
    owner = F.col("owner")
    both = base.withColumn("owner", F.explode(F.array(F.lit(0), F.lit(1))))
    routes = both.where("owner = 0 or seg % 2 = 0").select(
        "img", "seg", "owner", (F.col("seg") + 13 * (1 + owner)).alias("parent"), (F.col("seg") * 3 % 40 + owner * 6).alias("parent_x"),
        (F.col("seg") * 5 % 40).alias("parent_y"), (60 + F.col("z") + owner * (F.col("seg") % 60)).cast("double").alias("angle"))
    sections = both.where("seg % 5 = 0").select(
        "img", "seg", "owner", (4.5 + owner).alias("width"), (1.0 - 2 * owner).alias("offset"), F.lit(True).alias("bundle"),
        (F.col("seg") % 10 == 0).alias("parallel"), F.lit(7.0).alias("travelled"))
    segments = base.select("img", "seg", (F.col("z") * 37 % 360).cast("double").alias("upper_angle"))
    out = contacts.carried_sections(routes, sections, segments, contacts.profiles(points, ["img"]), base.where("seg % 4 = 0").select("img", "seg"), ["img"])
    return out.select("img", "seg", "owner", *[F.round(c, 6).alias(c) for c in ("width", "offset")], "bundle", "parallel", F.round("travelled", 6).alias("travelled"))
