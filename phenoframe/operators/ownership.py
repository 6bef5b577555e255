"""Segments split where earlier frames gave their pixels to other owners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from phenoframe.operators.runs import fragments
from phenoframe.operators.spatial import nearest
from phenoframe.runtime import cut


def _sets(rows: DataFrame, at: Sequence[str], **columns: Column) -> DataFrame:
    return rows.groupBy(*at).agg(*[F.array_sort(F.collect_set(value)).alias(name) for name, value in columns.items()])


def historical_fragments(
    points: DataFrame, routed: DataFrame, held: DataFrame, keys: Sequence[str], proven: DataFrame | None = None,
) -> DataFrame:
    """(keys, seg, fragment, owner, parent, parent_fragment, first_pos, last_pos): one row per fragment and owner.

    ``points`` has keys, seg, pos, x, y (pos ascends from the base); ``routed`` keys, seg, owner, parent, where parent is the
    segment the owner comes from or null; ``held`` keys, x, y, owner, exclusive: who held a pixel before, and whether alone.
    ``proven`` (keys, seg, owner) names owners that are known to be there now: they stay beside earlier ones.

    A point that was shared belongs to those who shared it, else to those who held it alone, else to the owners of its
    segment. An owner that a segment does not have yet comes from the nearest lower end of its own segments that lies no
    deeper than the first point it holds; without one it gets nothing. Fragments are numbered along the segment from 1 and those
    nobody may hold are left out. A fragment hangs below the owner's fragment before it; the first one below the last fragment of
    the owner's parent, or of the nearest ancestor in which the owner still holds something (null if there is none).
    """
    keys = list(keys)
    at, of = [*keys, "seg"], [*keys, "seg", "owner"]
    kind = routed.schema["owner"].dataType
    team = _sets(routed, at, _team=F.col("owner"))
    # As many owners meet in a pixel or a segment as plants stand in an image.
    before = _sets(held, [*keys, "x", "y"], _shared=F.when(~F.col("exclusive"), F.col("owner")), _alone=F.when(F.col("exclusive"), F.col("owner")))
    places = points.select(*at, "pos", "x", "y").join(team, at).join(before, [*keys, "x", "y"], "left")
    if proven is not None:
        places = places.join(_sets(proven, at, _proven=F.col("owner")), at, "left")
    else:
        places = places.withColumn("_proven", F.lit(None).cast(team.schema["_team"].dataType))
    sure = F.coalesce("_proven", F.array().cast(team.schema["_team"].dataType))
    alone = F.when(F.size("_alone") > 0, F.array_union("_alone", F.array_intersect("_team", sure))).otherwise(F.col("_team"))
    label = F.when(F.size("_shared") > 0, F.array_union("_shared", F.array_intersect(alone, sure))).otherwise(alone)
    places = cut(places.select(*at, "pos", "x", "y", "_team", label.alias("_label")), "places")

    entries = places.withColumn("owner", F.explode(F.array_except("_label", "_team"))).groupBy(*of).agg(
        F.min_by(F.struct("x", "y"), "pos").alias("_in"))
    ends = points.groupBy(*at).agg(F.max_by(F.struct("x", "y"), "pos").alias("_end")).join(routed.select(*of).distinct(), at)
    # An owner that is a guest in a segment has no end there, so no segment becomes its own parent.
    asked = cut(entries.select(*of, "_in.x", "_in.y"), "entries")
    lower = ends.select(*keys, "owner", "_end.x", "_end.y", F.col("seg").alias("parent"))
    found = nearest(asked, lower, [*keys, "owner"], above=True, rank="parent")
    guests = asked.join(found.select(*keys, "owner", "x", "y", "parent"), [*keys, "owner", "x", "y"]).select(*of, "parent")
    everyone = cut(routed.groupBy(*of).agg(F.min("parent").alias("parent")).unionByName(guests), "owners")

    allowed = _sets(everyone, at, _allowed=F.col("owner"))
    names = F.concat_ws(",", F.transform(F.array_sort(F.array_intersect("_label", "_allowed")), lambda v: v.cast("string")))
    cuts = fragments(places.join(allowed, at).select(*at, "pos", names.alias("_names")), at, "pos", F.col("_names"))
    kept = cut(cuts.where("label <> ''").select(
        *at, "fragment", "first_pos", "last_pos", F.explode(F.transform(F.split("label", ","), lambda v: v.cast(kind))).alias("owner")), "fragments")

    homes = _homes(everyone, kept.groupBy(*of).agg(F.max("fragment").alias("_last")), keys)
    along = Window.partitionBy(*of).orderBy("fragment")
    placed = kept.withColumn("_before", F.lag("fragment").over(along)).join(everyone, of)
    found = placed.join(homes.select(*keys, F.col("seg").alias("parent"), "owner", "home", "home_fragment"), [*keys, "parent", "owner"], "left")
    inside = F.col("_before").isNotNull()
    return found.select(
        *at, "fragment", "owner", F.when(inside, F.col("seg")).otherwise(F.col("home")).alias("parent"),
        F.when(inside, F.col("_before")).otherwise(F.col("home_fragment")).alias("parent_fragment"), "first_pos", "last_pos")


def _homes(everyone: DataFrame, last: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seg, owner, home, home_fragment): where an owner that comes from a segment really comes from.

    Segments in which the owner holds nothing are skipped by doubling steps, so a chain of n takes about log2(n) joins.
    """
    of = [*keys, "seg", "owner"]
    rows = everyone.join(last, of, "left").select(
        *of, F.when(F.col("_last").isNotNull(), F.col("seg")).alias("home"), F.col("_last").alias("home_fragment"),
        F.when(F.col("_last").isNull(), F.col("parent")).alias("up"))
    for _ in range(64):
        rows = cut(rows, "homes")
        if rows.where("up is not null").isEmpty():
            return rows
        above = rows.select(
            *keys, F.col("seg").alias("up"), "owner", F.col("home").alias("_home"), F.col("home_fragment").alias("_part"), F.col("up").alias("_up"))
        rows = rows.join(above, [*keys, "up", "owner"], "left").select(
            *of, F.coalesce("home", "_home").alias("home"), F.coalesce("home_fragment", "_part").alias("home_fragment"),
            F.when(F.col("home").isNull() & F.col("_home").isNull(), F.col("_up")).alias("up"))
    raise ValueError("a segment is its own ancestor")
