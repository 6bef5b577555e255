"""Dependency order of parent links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from phenoframe.runtime import cut


def dependency_levels(links: DataFrame, keys: Sequence[str], child: str, parent: str) -> DataFrame:
    """(keys, child, level): every node after all of its parents (Kahn, 1962).

    ``links`` may name several parents per child; a null parent, or one that is no child itself,
    is available from the start. Raises when links form a cycle.
    """
    keys = list(keys)
    nodes = links.select(*keys, child).distinct()
    inner = links.join(nodes.select(*keys, F.col(child).alias(parent)), [*keys, parent], "left_semi").select(*keys, child, parent)
    open_ = cut(nodes, "order")
    waits = cut(inner.distinct(), "waits")
    done = []
    level = 0
    while not open_.isEmpty():
        ready = cut(open_.join(waits.select(*keys, child).distinct(), [*keys, child], "left_anti"), "ready")
        if ready.isEmpty():
            raise ValueError("the links form a cycle")
        done.append(ready.withColumn("level", F.lit(level)))
        open_ = cut(open_.join(ready, [*keys, child], "left_anti"), "order")
        waits = cut(waits.join(ready.select(*keys, F.col(child).alias(parent)), [*keys, parent], "left_anti"), "waits")
        level += 1
    result = done[0] if done else nodes.withColumn("level", F.lit(0))
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def level_bridges(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Level segments between two junctions that are shorter than both end widths together.

    Needs upper_y, lower_y, upper_junction, lower_junction, length, first_width, last_width. Both
    junctions must have another arrival and another exit.
    """
    keys = list(keys)
    candidates = segments.where(
        "upper_junction is not null and lower_junction is not null and upper_junction <> lower_junction "
        "and upper_y = lower_y and length < first_width + last_width"
    )
    def degree(column, name):
        return segments.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_j")).agg(F.count(F.lit(1)).alias(name))
    load = degree("lower_junction", "_in").join(degree("upper_junction", "_out"), [*keys, "_j"])
    first = load.select(*keys, F.col("_j").alias("upper_junction"), F.col("_in").alias("_in1"), (F.col("_out") - 1).alias("_out1"))
    last = load.select(*keys, F.col("_j").alias("lower_junction"), (F.col("_in") - 1).alias("_in2"), F.col("_out").alias("_out2"))
    return candidates.join(first, [*keys, "upper_junction"]).join(last, [*keys, "lower_junction"]).where(
        "_in1 > 0 and _out1 > 0 and _in2 > 0 and _out2 > 0"
    ).select(*keys, "seg", "upper_junction", "lower_junction")


def merge_junctions(bridges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, junction, cluster): junctions joined by bridges share the smallest id."""
    from phenoframe.operators.components import connect

    return connect(bridges, keys, "upper_junction", "lower_junction").select(
        *keys, F.col("id").alias("junction"), F.col("label").alias("cluster")
    )


def crossed_bridges(bridges: DataFrame, trips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, trip, seg): bridges on the shortest way between the two junctions of a trip.

    Breadth-first search over all trips together. No junction is visited twice, so the rounds end
    after the bridges of the longest cluster.
    """
    keys = list(keys)
    both = bridges.select(*keys, "seg", F.col("upper_junction").alias("at"), F.col("lower_junction").alias("to")).unionByName(
        bridges.select(*keys, "seg", F.col("lower_junction").alias("at"), F.col("upper_junction").alias("to"))
    )
    none = F.array().cast("array<bigint>")
    front = cut(trips.select(*keys, "trip", F.col("start").alias("at"), "end", none.alias("path"), F.array("start").alias("seen")), "trips")
    found = []
    while True:
        found.append(front.where("at = end").select(*keys, "trip", "path"))
        ahead = front.where("at <> end").join(both, [*keys, "at"]).where("not array_contains(seen, to)")
        step = ahead.groupBy(*keys, "trip", "to", "end").agg(
            F.min(F.struct(F.concat("path", F.array(F.col("seg").cast("long"))).alias("path"), F.concat("seen", F.array("to")).alias("seen"))).alias("_s")
        ).select(*keys, "trip", F.col("to").alias("at"), "end", "_s.path", "_s.seen")
        over = found[-1].select(*keys, "trip")
        front = cut(step.join(over, [*keys, "trip"], "left_anti"), "trips")
        if front.isEmpty():
            break
    paths = found[0]
    for part in found[1:]:
        paths = paths.unionByName(part)
    return paths.select(*keys, "trip", F.explode("path").alias("seg"))
