"""Orientation of free tips that grow upwards from a rooted junction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from phenoframe.operators.forest import descending
from phenoframe.runtime import cut


def upward_tips(segments: DataFrame, links: DataFrame, owned: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, seg, anchor): segments to be turned round, and the arrival that then roots them.

    ``segments``: keys, seg, ends, junctions and length; ``links``: keys, seg, parent, parent_x, parent_y (a negative
    parent is a stem); ``owned``: keys, seg of segments that have an owner; ``held``: keys, seg of those that an owner
    had before. A tip is turned if its upper end is free, its lower end stands at a junction, it was not held before,
    does not hang on a stem, and its parent is missing or farther away than the tip is long. Another owned segment
    must arrive at the junction that does not descend from the tip itself; the nearest one is the anchor. Of tips that
    have only each other, all but the one with the largest id are turned.
    """
    keys = list(keys)
    at = [*keys, "seg"]
    first = links.groupBy(*at).agg(F.min(F.struct("parent", "parent_x", "parent_y")).alias("_p")).select(*at, "_p.parent", "_p.parent_x", "_p.parent_y")
    linked = cut(segments.join(first, at, "left"), "linked")
    away = F.hypot(F.col("upper_x") - F.col("parent_x"), F.col("upper_y") - F.col("parent_y"))
    tips = linked.where("upper_junction is null and lower_junction is not null and coalesce(parent, 0) >= 0").where(
        F.col("parent").isNull() | (away > F.col("length"))).join(held.select(*at).distinct(), at, "left_anti")
    tips = cut(tips.select(*at, "lower_junction", "lower_x", "lower_y"), "tips")
    marked = tips.select(*keys, F.col("seg").alias("arrival"), F.lit(True).alias("_tip"))
    arrivals = linked.where("lower_junction is not null").join(owned.select(*at).distinct(), at, "left_semi").select(
        *keys, "lower_junction", F.col("seg").alias("arrival"), F.col("lower_x").alias("ax"), F.col("lower_y").alias("ay"))
    near = F.hypot(F.col("ax") - F.col("lower_x"), F.col("ay") - F.col("lower_y"))
    pairs = tips.join(arrivals, [*keys, "lower_junction"]).where("arrival <> seg").join(marked, [*keys, "arrival"], "left").where(
        "_tip is null or arrival > seg").select(*at, "arrival", near.alias("near"))
    pairs = cut(pairs, "pairs")
    below = descending(pairs, linked, keys, "seg", "parent", "arrival", "seg")
    rooted = pairs.join(below, [*at, "arrival"], "left_anti")
    return rooted.groupBy(*at).agg(F.min_by("arrival", F.struct("near", "arrival")).alias("anchor"))


def turned_segments(segments: DataFrame, turned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``segments`` with both ends of the turned ones (keys, seg) exchanged, the junction now at the upper end."""
    at = [*keys, "seg"]
    rows = segments.join(turned.select(*at, F.lit(True).alias("_turned")), at, "left")
    changed = {}
    for part in ("x", "y", "angle"):
        for side, other in (("upper", "lower"), ("lower", "upper")):
            changed[f"{side}_{part}"] = F.when(F.col("_turned"), F.col(f"{other}_{part}")).otherwise(F.col(f"{side}_{part}"))
    changed["upper_junction"] = F.when(F.col("_turned"), F.col("lower_junction")).otherwise(F.col("upper_junction"))
    changed["lower_junction"] = F.when(F.col("_turned").isNull(), F.col("lower_junction"))
    return rows.withColumns(changed).select(*segments.columns)


def turned_links(links: DataFrame, turned: DataFrame, segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``links`` (keys, seg, parent, parent_x, parent_y, ...) without those of turned tips.

    What hung on the old lower end of a tip hangs on the tip's anchor, so it is not orphaned.
    """
    keys = list(keys)
    at = [*keys, "seg"]
    ends = segments.select(*keys, F.col("seg").alias("anchor"), F.col("lower_x").alias("_ax"), F.col("lower_y").alias("_ay"))
    moved = turned.join(ends, [*keys, "anchor"]).select(*keys, F.col("seg").alias("parent"), "anchor", "_ax", "_ay")
    rows = links.join(turned.select(*at), at, "left_anti").join(moved, [*keys, "parent"], "left")
    return rows.withColumns({
        "parent": F.coalesce("anchor", "parent"), "parent_x": F.coalesce("_ax", "parent_x"), "parent_y": F.coalesce("_ay", "parent_y")}).select(*links.columns)
