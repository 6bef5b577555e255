"""Temporal and physical evidence for ownership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from phenoframe.functions.angles import turn
from phenoframe.operators.components import component_stats
from phenoframe.operators.spatial import minimum_gap, pairs_within

# Tolerance in pixels, smallest count and smallest share of the segment.
VOTES = ((2, 5.0, 0.2), (4, 10.0, 0.5), (8, 10.0, 0.5))
MAJORITY = 0.8


def coverage_vote(points: DataFrame, history: DataFrame, keys: Sequence[str], segment: str, owner: str) -> DataFrame:
    """(keys, segment, owner, share): one earlier owner per segment, if the evidence is clear.

    A segment pixel votes for an owner when that owner alone was within the tolerance. The
    tightest tolerance with enough votes and an 80 % majority decides. One join at the widest
    tolerance serves all three.
    """
    near = pairs_within(points, history, VOTES[-1][0], keys, [owner])
    place = [*keys, "x", "y"]
    reach = {t: t * t for t, _, _ in VOTES}
    alone = near.groupBy(*place).agg(*[F.count_if(F.col("d2") <= d2).alias(f"_near{t}") for t, d2 in reach.items()])
    voted = near.join(alone, place)
    per_owner = points.select(*keys, segment, "x", "y").join(voted, place).groupBy(*keys, segment, owner).agg(
        *[F.count_if((F.col("d2") <= d2) & (F.col(f"_near{t}") == 1)).alias(f"_v{t}") for t, d2 in reach.items()]
    )
    sizes = points.groupBy(*keys, segment).agg(F.count(F.lit(1)).alias("_size"))
    best = per_owner.groupBy(*keys, segment).agg(
        *[F.max(F.struct(F.col(f"_v{t}").alias("v"), (-F.col(owner)).alias("o"))).alias(f"_b{t}") for t in reach],
        *[F.sum(f"_v{t}").alias(f"_t{t}") for t in reach],
    ).join(sizes, [*keys, segment])
    decided = F.lit(None).cast("struct<v:bigint,o:bigint>")
    for t, least, share in reversed(VOTES):
        won = F.struct(F.col(f"_b{t}.v").alias("v"), (-F.col(f"_b{t}.o")).cast("long").alias("o"))
        enough = F.greatest(F.lit(least), F.col("_size") * share)
        decided = F.when((won["v"] >= enough) & (won["v"] >= F.col(f"_t{t}") * MAJORITY), won).otherwise(decided)
    return best.withColumn("_won", decided).where("_won is not null").select(
        *keys, segment, F.col("_won.o").alias(owner), (F.col("_won.v") / F.col("_size")).alias("share")
    )


def gap_gate(candidates: DataFrame, labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates (keys, child_label, parent_label) whose gap is physically plausible.

    Elongated components may link anywhere; others only to their own component or across a gap
    not longer than their own extent.
    """
    stats = component_stats(labelled, keys).select(*keys, F.col("label").alias("child_label"), F.col("extent").alias("_extent"), "elongated")
    pairs = candidates.select(*keys, "child_label", "parent_label").distinct()
    judged = pairs.join(stats, [*keys, "child_label"], "left")
    free = judged.where("child_label = parent_label or elongated or elongated is null").select(*keys, "child_label", "parent_label")
    tested = judged.where("child_label <> parent_label and not elongated")
    side = [*keys, "child_label", "parent_label"]
    kids = tested.select(*side).join(labelled.withColumnRenamed("label", "child_label"), [*keys, "child_label"])
    olds = tested.select(*side).join(labelled.withColumnRenamed("label", "parent_label"), [*keys, "parent_label"])
    gaps = minimum_gap(kids, olds, side)
    near = tested.join(gaps, side).where("gap <= _extent").select(*side)
    return candidates.join(free.unionByName(near), side, "left_semi")


def line_direction(points: DataFrame, path: Sequence[str], arc: str, low: Column, high: Column) -> DataFrame:
    """Direction of each path between two arc positions, by a length-weighted line fit.

    The moments of every piece are integrated along its length, so dense sampling does not
    weigh more. ``points`` carries ``_nx``, ``_ny`` and ``_narc`` of the next point.
    """
    start, end = F.greatest(F.col(arc), low), F.least(F.col("_narc"), high)
    span = F.col("_narc") - F.col(arc)
    def at(position, a, b):
        return F.col(a) + (F.col(b) - F.col(a)) * (position - F.col(arc)) / span
    cutoff = points.where((start < end) & (span > 0)).select(
        *path, (end - start).alias("_w"), F.col(arc).alias("_arc"),
        at(start, "x", "_nx").alias("_ax"), at(start, "y", "_ny").alias("_ay"), at(end, "x", "_nx").alias("_bx"), at(end, "y", "_ny").alias("_by"),
    )
    w = F.col("_w")
    def moment(a0, a1, b0, b1):
        a0, a1, b0, b1 = (F.col(c) for c in (a0, a1, b0, b1))
        return F.sum(w * ((a0 * b0 + a1 * b1) / 3.0 + (a0 * b1 + a1 * b0) / 6.0))
    sums = cutoff.groupBy(*path).agg(
        F.sum("_w").alias("_sw"), F.sum(w * (F.col("_ax") + F.col("_bx")) / 2.0).alias("_sx"), F.sum(w * (F.col("_ay") + F.col("_by")) / 2.0).alias("_sy"),
        moment("_ax", "_bx", "_ax", "_bx").alias("_xx"), moment("_ay", "_by", "_ay", "_by").alias("_yy"), moment("_ax", "_bx", "_ay", "_by").alias("_xy"),
        F.min_by(F.struct("_ax", "_ay"), "_arc").alias("_p"), F.max_by(F.struct("_bx", "_by"), "_arc").alias("_q"),
    )
    mx, my = F.col("_sx") / F.col("_sw"), F.col("_sy") / F.col("_sw")
    cxx, cyy, cxy = F.col("_xx") / F.col("_sw") - mx * mx, F.col("_yy") / F.col("_sw") - my * my, F.col("_xy") / F.col("_sw") - mx * my
    axis = F.degrees(F.atan2(2.0 * cxy, cxx - cyy) / 2.0)
    along = F.cos(F.radians(axis)) * (F.col("_q._bx") - F.col("_p._ax")) + F.sin(F.radians(axis)) * (F.col("_q._by") - F.col("_p._ay"))
    return sums.select(*path, F.pmod(F.when(along < 0, axis + 180.0).otherwise(axis), F.lit(360.0)).alias("direction"))


def least_turn(options: DataFrame, keys: Sequence[str], owner: str, incoming: str, outgoing: str) -> DataFrame:
    """Owner that continues most straight; no row when the two best are equally straight."""
    scored = options.withColumn("_turn", turn(F.col(outgoing), F.col(incoming)))
    best = scored.groupBy(*keys).agg(F.min("_turn").alias("_best"))
    return scored.join(best, list(keys)).where("_turn <= _best + 1e-8").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(owner).alias(owner), F.min("_turn").alias("turn")
    ).where("_n = 1").drop("_n")
