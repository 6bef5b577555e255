"""Polylines from skeleton pixels by pointer doubling.

Every pixel contact is walked in both directions as a dart. A dart's successor leaves its head
by the other contact when the head has exactly two; otherwise the dart ends there. Doubling the
successor pointer gives each dart its final dart and its distance to it in about log2(longest
path) equi-joins over all images together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from phenoframe.operators.components import code_x, code_y, connect, pixel_code
from phenoframe.runtime import cut


def contacts(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, a, b): touching pixels as codes, both directions, without diagonal shortcuts.

    A diagonal contact is left out when one of the two pixels beside it is set, because the path
    round the corner already exists.
    """
    here = px.select(*keys, "x", "y").distinct()
    # Each pixel announces itself to the positions it can affect: neighbours and corners.
    straight = [(1, 0), (-1, 0), (0, 1), (0, -1)]
    diagonal = [(i, j) for i in (-1, 1) for j in (-1, 1)]
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in straight + diagonal])
    pairs = here.withColumn("_o", F.explode(steps)).select(
        *keys, "x", "y", (F.col("x") + F.col("_o.i")).alias("_tx"), (F.col("y") + F.col("_o.j")).alias("_ty")
    )
    there = here.select(*keys, F.col("x").alias("_tx"), F.col("y").alias("_ty"))
    pairs = pairs.join(there, [*keys, "_tx", "_ty"])
    slanted = (F.col("x") != F.col("_tx")) & (F.col("y") != F.col("_ty"))
    corner = F.array(
        F.struct(F.col("_tx").alias("cx"), F.col("y").alias("cy")), F.struct(F.col("x").alias("cx"), F.col("_ty").alias("cy"))
    )
    corners = pairs.where(slanted).withColumn("_c", F.explode(corner)).select(
        *keys, "x", "y", "_tx", "_ty", F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy")
    )
    shortcuts = corners.join(
        here.select(*keys, F.col("x").alias("_cx"), F.col("y").alias("_cy")), [*keys, "_cx", "_cy"], "left_semi"
    ).select(*keys, "x", "y", "_tx", "_ty").distinct()
    kept = pairs.join(shortcuts, [*keys, "x", "y", "_tx", "_ty"], "left_anti")
    return kept.select(*keys, pixel_code("x", "y").alias("a"), pixel_code(F.col("_tx"), F.col("_ty")).alias("b"))


def order_paths(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, path_a, path_b, pos, a, b): every contact once, ordered along its path.

    ``edges`` holds both directions. Paths split at pixels whose contact count is not two. A pure
    cycle is opened at its smallest pixel. A path starts at its smaller end and is named by its
    first contact.
    """
    keys = list(keys)
    edges = cut(edges.select(*keys, "a", "b").distinct(), "contacts")
    degree = edges.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("_deg"), F.min("b").alias("_n1"), F.max("b").alias("_n2"))
    labels = connect(edges, keys).select(*keys, F.col("id").alias("a"), "label")
    nodes = degree.join(labels, [*keys, "a"])
    loops = nodes.groupBy(*keys, "label").agg(F.bool_and(F.col("_deg") == 2).alias("_loop")).where("_loop")
    nodes = cut(
        nodes.join(loops, [*keys, "label"], "left").select(
            *keys, "a", "_n1", "_n2",
            ((F.col("_deg") != 2) | (F.coalesce("_loop", F.lit(False)) & (F.col("a") == F.col("label")))).alias("_stop"),
        ),
        "nodes",
    )
    heads = nodes.select(*keys, F.col("a").alias("b"), F.col("_stop").alias("_end"), "_n1", "_n2")
    onward = F.when(~F.col("_end"), F.when(F.col("_n1") == F.col("a"), F.col("_n2")).otherwise(F.col("_n1")))
    darts = edges.join(heads, [*keys, "b"]).select(
        *keys, "a", "b", F.when(~F.col("_end"), F.col("b")).alias("na"), onward.alias("nb"),
        F.col("a").alias("ea"), F.col("b").alias("eb"), F.lit(0).cast("long").alias("hops"),
    )
    darts = cut(darts, "darts")
    while not darts.where("na is not null").isEmpty():
        ahead = darts.select(
            *keys, F.col("a").alias("na"), F.col("b").alias("nb"), F.col("na").alias("_na"), F.col("nb").alias("_nb"),
            F.col("ea").alias("_ea"), F.col("eb").alias("_eb"), F.col("hops").alias("_hops"),
        )
        open_ = darts.where("na is not null").join(ahead, [*keys, "na", "nb"]).select(
            *keys, "a", "b", F.col("_na").alias("na"), F.col("_nb").alias("nb"), F.col("_ea").alias("ea"),
            F.col("_eb").alias("eb"), (F.col("hops") + F.col("_hops") + 1).alias("hops"),
        )
        darts = cut(darts.where("na is null").unionByName(open_), "darts")
    # The reverse of a path's last dart is the first dart of the way back.
    stops = nodes.where("_stop").select(*keys, "a")
    first = darts.join(stops, [*keys, "a"], "left_semi").select(
        *keys, F.col("a").alias("path_a"), F.col("b").alias("path_b"), "ea", "eb", F.col("hops").alias("_total")
    )
    forward = (F.col("path_a") < F.col("eb")) | ((F.col("path_a") == F.col("eb")) & (F.col("path_b") <= F.col("ea")))
    first = first.where(forward)
    return darts.join(first, [*keys, "ea", "eb"]).select(
        *keys, "path_a", "path_b", (F.col("_total") - F.col("hops")).alias("pos"), "a", "b"
    )


def trace_polylines(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, path_a, path_b, pos, x, y): skeleton pixels as ordered polylines.

    Every contact belongs to one polyline; isolated pixels give a polyline of one point.
    """
    keys = list(keys)
    here = cut(px.select(*keys, "x", "y").distinct(), "skeleton")
    edges = cut(contacts(here, keys), "contacts")
    ordered = order_paths(edges, keys)
    heads = ordered.select(*keys, "path_a", "path_b", (F.col("pos") + 1).alias("pos"), F.col("b").alias("_p"))
    tails = ordered.where("pos = 0").select(*keys, "path_a", "path_b", "pos", F.col("a").alias("_p"))
    coded = here.withColumn("_p", pixel_code("x", "y"))
    alone = coded.join(edges.select(*keys, F.col("a").alias("_p")).distinct(), [*keys, "_p"], "left_anti").select(
        *keys, F.col("_p").alias("path_a"), F.col("_p").alias("path_b"), F.lit(0).cast("long").alias("pos"), "_p"
    )
    return tails.unionByName(heads).unionByName(alone).select(
        *keys, "path_a", "path_b", "pos", code_x(F.col("_p")).alias("x"), code_y(F.col("_p")).alias("y")
    )


def segment_ends(points: DataFrame, keys: Sequence[str], sample: int = 10) -> DataFrame:
    """Upper and lower end of every open path with their outward directions.

    ``points`` are ordered polyline points (keys, path_a, path_b, pos, x, y). The direction is
    the mean step over the ``sample`` pixels next to each end.
    """
    path = [*keys, "path_a", "path_b"]
    last = points.groupBy(*path).agg(F.max("pos").alias("_last"))
    near = sample - 1
    marked = points.join(last, path).where("_last > 0")
    ends = marked.groupBy(*path).agg(
        F.max("_last").alias("n_steps"),
        *[
            F.max(F.when(F.col("pos") == at, F.col(c))).alias(name + c)
            for name, at in (
                ("_s", F.lit(0)), ("_t", F.least(F.lit(near), F.col("_last"))),
                ("_e", F.col("_last")), ("_f", F.greatest(F.lit(0), F.col("_last") - near)),
            )
            for c in ("x", "y")
        ],
    )
    def outward(a, b):
        dx, dy = F.col(a + "x") - F.col(b + "x"), F.col(a + "y") - F.col(b + "y")
        return F.when((dx == 0) & (dy == 0), F.lit(90.0)).otherwise(F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0)))

    start = F.struct(F.col("_sx").alias("x"), F.col("_sy").alias("y"), outward("_s", "_t").alias("angle"))
    end = F.struct(F.col("_ex").alias("x"), F.col("_ey").alias("y"), outward("_e", "_f").alias("angle"))
    flipped = (F.col("_sy") > F.col("_ey")) | ((F.col("_sy") == F.col("_ey")) & (F.col("_sx") > F.col("_ex")))
    ends = ends.where("_sx <> _ex or _sy <> _ey")
    return ends.select(
        *path, "n_steps", F.when(flipped, end).otherwise(start).alias("upper"), F.when(flipped, start).otherwise(end).alias("lower"),
        flipped.alias("flipped"),
    )
