"""Binding of segments split at earlier ownership."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoframe.operators import ownership
from phenoframe.plans.registry import query, table

SPLIT = """p AS (SELECT l_orderkey % 11 AS img, l_orderkey AS seg, l_linenumber AS pos, l_partkey % 61 AS x, l_suppkey % 7 * 9 + l_linenumber AS y FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1),
s AS (SELECT DISTINCT img, seg FROM p),
r AS (SELECT s.img, s.seg, w.owner, o.seg AS parent FROM s, LATERAL (SELECT unnest(CASE WHEN s.seg % 4 = 0 THEN [s.seg % 3, 3] ELSE [s.seg % 3] END) AS owner) w
  LEFT JOIN s o ON o.seg = s.seg - 11 * 32 AND s.seg % 5 <> 0),
h AS (SELECT DISTINCT l_orderkey % 11 AS img, l_partkey % 61 AS x, l_suppkey % 7 * 9 + l_linenumber AS y, l_suppkey % 5 AS owner, l_suppkey % 4 <> 1 AS exclusive FROM lineitem WHERE l_suppkey % 6 = 1),
v AS (SELECT img, seg, owner FROM r WHERE seg % 8 = 0),
t AS (SELECT img, seg, list_sort(list(owner)) AS team FROM r GROUP BY 1, 2),
u AS (SELECT img, seg, list(owner) AS sure FROM v GROUP BY 1, 2),
b AS (SELECT img, x, y, list(owner) FILTER (NOT exclusive) AS shared, list(owner) FILTER (exclusive) AS alone FROM h GROUP BY 1, 2, 3),
a AS (SELECT p.*, team, coalesce(sure, []) AS sure, shared, CASE WHEN len(alone) > 0 THEN list_concat(alone, list_intersect(team, coalesce(sure, []))) ELSE team END AS alone
  FROM p JOIN t USING (img, seg) LEFT JOIN u USING (img, seg) LEFT JOIN b USING (img, x, y)),
l AS (SELECT img, seg, pos, x, y, team, CASE WHEN len(shared) > 0 THEN list_concat(shared, list_intersect(alone, sure)) ELSE alone END AS label FROM a),
n AS (SELECT img, seg, owner, arg_min(x, pos) AS ix, arg_min(y, pos) AS iy FROM (SELECT *, unnest(label) AS owner FROM l) WHERE NOT list_contains(team, owner) GROUP BY 1, 2, 3),
e AS (SELECT p.img, p.seg, arg_max(x, pos) AS ex, arg_max(y, pos) AS ey FROM p GROUP BY 1, 2),
g AS (SELECT n.img, n.seg, n.owner, e.seg AS parent FROM n JOIN r o ON o.img = n.img AND o.owner = n.owner AND o.seg <> n.seg JOIN e ON e.img = o.img AND e.seg = o.seg WHERE ey <= iy
  QUALIFY row_number() OVER (PARTITION BY n.img, n.seg, n.owner ORDER BY (ex - ix) ** 2 + (ey - iy) ** 2, e.seg) = 1),
w AS (SELECT img, seg, owner, parent FROM r UNION ALL SELECT * FROM g),
m AS (SELECT img, seg, list(owner) AS allowed FROM w GROUP BY 1, 2),
f AS (SELECT l.img, l.seg, pos, list_sort(list_distinct(list_intersect(label, allowed))) AS label FROM l JOIN m USING (img, seg)),
c AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY img, seg ORDER BY pos) OR row_number() OVER (PARTITION BY img, seg ORDER BY pos) = 1 THEN 1 ELSE 0 END AS new FROM f),
d AS (SELECT *, sum(new) OVER (PARTITION BY img, seg ORDER BY pos) AS fragment FROM c),
k AS (SELECT img, seg, fragment, owner, min(pos) AS first_pos, max(pos) AS last_pos FROM (SELECT *, unnest(label) AS owner FROM d) GROUP BY 1, 2, 3, 4),
z AS (SELECT w.*, (SELECT max(fragment) FROM k WHERE k.img = w.img AND k.seg = w.seg AND k.owner = w.owner) AS part FROM w),
up AS (SELECT img, seg, owner, seg AS home, parent, part FROM z UNION ALL
  SELECT up.img, up.seg, up.owner, z.seg, z.parent, z.part FROM up JOIN z ON z.img = up.img AND z.seg = up.parent AND z.owner = up.owner WHERE up.part IS NULL),
q AS (SELECT img, seg, owner, home, part FROM up WHERE part IS NOT NULL)"""


@query("historical_fragments", f"""WITH RECURSIVE {SPLIT}
SELECT img, seg, CAST(fragment AS BIGINT) AS fragment, CAST(owner AS BIGINT) AS owner, CASE WHEN before IS NULL THEN q.home ELSE k.seg END AS parent,
  CAST(coalesce(before, q.part) AS BIGINT) AS parent_fragment, first_pos, last_pos
FROM (SELECT k.*, lag(fragment) OVER (PARTITION BY img, seg, owner ORDER BY fragment) AS before FROM k) k JOIN w USING (img, seg, owner)
LEFT JOIN q ON q.img = w.img AND q.seg = w.parent AND q.owner = w.owner""".replace("SELECT img, seg, CAST(fragment", "SELECT k.img, k.seg, CAST(fragment").replace("CAST(owner AS BIGINT)", "CAST(k.owner AS BIGINT)"))
def historical_fragments(spark, folder):
    """Orders as segments, lines as their points; some suppliers held the pixels before."""
    key, line = F.col("l_orderkey"), table(spark, folder, "lineitem")
    x, y = F.col("l_partkey") % 61, F.col("l_suppkey") % 7 * 9 + F.col("l_linenumber")
    points = line.groupBy((key % 11).alias("img"), key.alias("seg"), F.col("l_linenumber").alias("pos")).agg(
        F.min_by(F.struct(x.alias("x"), y.alias("y")), F.struct("l_partkey", "l_suppkey")).alias("p")).select("img", "seg", "pos", "p.x", "p.y")
    seg = F.col("seg")
    owners = F.when(seg % 4 == 0, F.array(seg % 3, F.lit(3).cast("long"))).otherwise(F.array(seg % 3))
    segments = points.select("img", "seg").distinct()
    above = segments.select((seg + 11 * 32).alias("seg"), seg.alias("parent")).where(seg % 5 != 0)
    routed = segments.join(above, "seg", "left").select("img", "seg", F.explode(owners).alias("owner"), "parent")
    held = line.where("l_suppkey % 6 = 1").select(
        (key % 11).alias("img"), x.alias("x"), y.alias("y"), (F.col("l_suppkey") % 5).alias("owner"), (F.col("l_suppkey") % 4 != 1).alias("exclusive"))
    return ownership.historical_fragments(points, routed, held.distinct(), ["img"], routed.where("seg % 8 = 0").select("img", "seg", "owner"))
