"""Parent chains of any depth: totals, members and descendants by pointer doubling, without stored paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from phenoframe.runtime import cut


def chain_totals(
    links: DataFrame, keys: Sequence[str], node: str, parent: str, sums: Sequence[str] = (), *, top: str | None = None, circles: bool = False
) -> tuple[DataFrame, list[DataFrame]]:
    """Sums of columns over every node and its ancestors, and the jump tables that were used.

    ``top`` names a column for the last node of each chain.

    ``links`` has one row per (keys, node). A parent that is null or no node ends its chain. Jump table k holds
    (keys, node, up): the ancestor 2^k steps up, where there is one. Raises on a cycle, or, with ``circles``, leaves out nodes whose chain has no end.
    """
    keys, sums = list(keys), list(sums)
    inner = links.select(*keys, F.col(node).alias("_up")).distinct().withColumn("_known", F.lit(True))
    state = cut(links.select(*keys, F.col(node).alias("_node"), F.col(parent).alias("_up"), *sums).join(inner, [*keys, "_up"], "left").select(
        *keys, "_node", F.when(F.col("_known"), F.col("_up")).alias("_up"), F.col("_node").alias("_top"), *sums), "chain")
    nodes, jumps = state.count(), []
    while not (jump := state.where("_up is not null").select(*keys, F.col("_node").alias(node), F.col("_up").alias("up"))).isEmpty():
        if 1 << len(jumps) > nodes:
            if circles:
                state = state.where("_up is null")
                break
            raise ValueError("the links form a cycle")
        jumps.append(jump)
        above = state.select(*keys, F.col("_node").alias("_up"), F.col("_up").alias("_next"), F.col("_top").alias("_last"), *[F.col(s).alias(f"_s_{s}") for s in sums])
        state = cut(state.join(above, [*keys, "_up"], "left").select(
            *keys, "_node", F.col("_next").alias("_up"), F.coalesce("_last", "_top").alias("_top"), *[(F.col(s) + F.coalesce(f"_s_{s}", F.lit(0))).alias(s) for s in sums]), "chain")
    named = [F.col("_top").alias(top)] if top else []
    return state.select(*keys, F.col("_node").alias(node), *named, *sums), jumps


def chain_members(starts: DataFrame, jumps: Sequence[DataFrame], keys: Sequence[str], node: str) -> DataFrame:
    """Every row of ``starts`` once for its node and once for each ancestor of it, put in place of the node."""
    keys = list(keys)
    rows = starts
    for jump in jumps:
        moved = rows.join(jump, [*keys, node]).withColumn(node, F.col("up")).drop("up").select(*starts.columns)
        rows = cut(rows.unionByName(moved), "members")
    return rows


def with_descendant(marked: DataFrame, jumps: Sequence[DataFrame], keys: Sequence[str], node: str) -> DataFrame:
    """(keys, node) of the nodes below which, or at which, a marked node lies."""
    keys = list(keys)
    rows = marked.select(*keys, node).distinct()
    for jump in jumps:
        rows = cut(rows.unionByName(rows.join(jump, [*keys, node]).select(*keys, F.col("up").alias(node))).distinct(), "below")
    return rows


def _rings(links: DataFrame, keys: list[str], node: str, parent: str) -> DataFrame:
    """(keys, node, low): the nodes of circles, with the smallest node of their circle."""
    steps = cut(links.select(*keys, F.col(node).alias("_node"), F.col(parent).alias("_up")).join(
        links.select(*keys, F.col(node).alias("_up")).distinct(), [*keys, "_up"], "left_semi").distinct(), "steps")
    # Every round doubles the steps. Chains that end lose nodes in each, so what no longer shrinks runs into circles,
    # and nodes that are still reached when their number no longer falls lie on them.
    state, last = steps, None
    while True:
        size = state.agg(F.count(F.lit(1)), F.count_distinct(*keys, "_up")).first()
        if size[0] == 0 or size == last:
            break
        last = size
        state = cut(state.join(state.select(*keys, F.col("_node").alias("_up"), F.col("_up").alias("_next")), [*keys, "_up"]).select(
            *keys, "_node", F.col("_next").alias("_up")), "steps")
    on = state.select(*keys, F.col("_up").alias("_node")).distinct()
    ring = cut(steps.join(on, [*keys, "_node"], "left_semi").select(*keys, "_node", "_up", F.col("_node").alias("_low")), "ring")
    while True:
        above = ring.select(*keys, F.col("_node").alias("_up"), F.col("_up").alias("_next"), F.col("_low").alias("_lower"))
        wider = cut(ring.join(above, [*keys, "_up"]).select(
            *keys, "_node", F.col("_next").alias("_up"), F.least("_low", "_lower").alias("_low"), (F.col("_lower") < F.col("_low")).alias("_new")), "ring")
        ring = wider.drop("_new")
        if wider.where("_new").isEmpty():
            return ring.select(*keys, F.col("_node").alias(node), F.col("_low").alias("low"))


def descending(pairs: DataFrame, links: DataFrame, keys: Sequence[str], node: str, parent: str, lower: str, upper: str) -> DataFrame:
    """The (keys, lower, upper) of ``pairs`` in which ``upper`` is ``lower`` or one of its ancestors.

    ``links`` has one row per (keys, node) and may hold circles. Circles are opened at their smallest node; the lower node
    of a pair is then lifted to the depth of the upper one, so there are never more rows than pairs and nodes.
    """
    keys = list(keys)
    rings = cut(_rings(links, keys, node, parent), "rings")
    first = rings.select(*keys, F.col("low").alias(node), F.lit(True).alias("_open")).distinct()
    tree = links.select(*keys, node, parent).join(first, [*keys, node], "left").select(
        *keys, node, F.when(F.col("_open").isNull(), F.col(parent)).alias("_above"), F.lit(1).cast("long").alias("_depth"))
    totals, jumps = chain_totals(tree, keys, node, "_above", ["_depth"], top="_top")
    held = totals.join(rings, [*keys, node], "left")
    asked = pairs.select(*keys, lower, upper).distinct()
    asked = asked.join(totals.select(*keys, F.col(node).alias(lower), F.col("_depth").alias("_deep"), "_top"), [*keys, lower]).join(
        held.select(*keys, F.col(node).alias(upper), "_depth", F.col("_top").alias("_other"), "low"), [*keys, upper]).where("_top = _other")
    rows = cut(asked.select(
        *keys, lower, upper, F.col(lower).alias("_at"), (F.col("_deep") - F.col("_depth")).alias("_lift"), F.coalesce(F.col("low") == F.col("_top"), F.lit(False)).alias("_round")), "lifts")
    for k, jump in enumerate(jumps):
        step = jump.select(*keys, F.col(node).alias("_at"), F.col("up").alias("_up"))
        due = (F.col("_lift") > 0) & ((F.shiftright("_lift", k) % 2) == 1)
        rows = cut(rows.join(step, [*keys, "_at"], "left").withColumn("_at", F.when(due, F.col("_up")).otherwise(F.col("_at"))).select(
            *keys, lower, upper, "_at", "_lift", "_round"), "lifts")
    return rows.where(F.col("_round") | ((F.col("_lift") >= 0) & (F.col("_at") == F.col(upper)))).select(*keys, lower, upper)
