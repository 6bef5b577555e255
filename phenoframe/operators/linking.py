"""Ownership of root segments: rooted links and junction routing.

All groups of one frame number are decided together. Decisions that depend on each other are
made in rounds: a segment is decided once everything it could depend on is decided.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from phenoframe.operators import chains, components, contacts, matching, pixels
from phenoframe.operators.evidence import gap_gate, least_turn, line_direction
from phenoframe.operators.runs import next_point
from phenoframe.operators.skeleton import widths
from phenoframe.operators.spatial import nearest
from phenoframe.runtime import cut

# Weights of the routing score.
ORDER_WEIGHT = 1e-6
FOREIGN_WEIGHT = 180.0
NOTHING = -(1 << 62)


def end_junctions(ends: DataFrame, junctions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, x, y, junction): the junction whose label alone occurs round an end."""
    spread = ends.select(*keys, "x", "y").distinct().select(
        *keys, "x", "y",
        F.explode(F.array(*[F.struct((F.col("x") + i).alias("jx"), (F.col("y") + j).alias("jy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("_o"),
    ).select(*keys, "x", "y", F.col("_o.jx").alias("jx"), F.col("_o.jy").alias("jy"))
    marks = junctions.select(*keys, F.col("x").alias("jx"), F.col("y").alias("jy"), "label")
    return spread.join(marks, [*keys, "jx", "jy"]).groupBy(*keys, "x", "y").agg(
        F.count_distinct("label").alias("_n"), F.min("label").alias("junction")
    ).where("_n = 1").drop("_n")


def frame_segments(
    skel: DataFrame, fg: DataFrame, keys: Sequence[str], width: int, height: int, min_pixels: int = 8
) -> tuple[DataFrame, DataFrame]:
    """(segments, points) of one frame for all groups; ``fg`` carries component labels.

    segments: keys, seg, upper/lower x, y, angle, junction, lower_is_tip, component.
    points: keys, seg, pos (from the upper end), x, y, width.
    """
    keys = list(keys)
    skel = cut(skel.select(*keys, "x", "y").distinct(), "skeleton")
    branch = pixels.branch_points(skel, keys)
    pieces = skel.join(branch, [*keys, "x", "y"], "left_anti")
    kept = cut(components.drop_small(components.label_pixels(pieces, keys), keys, min_pixels).select(*keys, "x", "y"), "kept")
    junctions = cut(components.label_pixels(skel.join(kept, [*keys, "x", "y"], "left_anti"), keys), "junctions")
    traced = cut(chains.trace_polylines(kept, keys), "traced")
    ends = cut(chains.segment_ends(traced, keys), "ends")
    found = ends.select(*keys, F.col("path_a").alias("seg"), "upper", "lower", "flipped", F.col("n_steps").alias("n_steps"))
    both = found.select(*keys, "upper.x", "upper.y").unionByName(found.select(*keys, "lower.x", "lower.y"))
    touch = end_junctions(both, junctions, keys)
    tips = pixels.line_ends(skel, keys).withColumn("_tip", F.lit(True))
    def at(side, df, name, value):
        return df.select(*keys, F.col("x").alias(f"{side}_x"), F.col("y").alias(f"{side}_y"), F.col(value).alias(name))
    segments = found.select(
        *keys, "seg", "flipped", "n_steps",
        *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("upper", "lower") for c in ("x", "y", "angle")],
    )
    for side, df, name, value in (
        ("upper", touch, "upper_junction", "junction"), ("lower", touch, "lower_junction", "junction"),
        ("lower", tips, "lower_is_tip", "_tip"), ("upper", fg, "component", "label"),
    ):
        segments = segments.join(at(side, df, name, value), [*keys, f"{side}_x", f"{side}_y"], "left")
    segments = cut(segments.na.fill(False, ["lower_is_tip"]), "segments")
    wide = widths(kept, fg, keys, width, height)
    flips = segments.select(*keys, "seg", "flipped", "n_steps")
    points = traced.select(*keys, F.col("path_a").alias("seg"), "pos", "x", "y").join(flips, [*keys, "seg"]).withColumn(
        "pos", F.when(F.col("flipped"), F.col("n_steps") - F.col("pos")).otherwise(F.col("pos"))
    ).drop("flipped", "n_steps")
    points = cut(points.join(wide, [*keys, "x", "y"], "left"), "points")
    return segments, points


def forced_owners(points: DataFrame, history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, seg, owner): first earlier owner sharing any exact pixel with the segment."""
    return points.join(history.select(*keys, "owner", "x", "y"), [*keys, "x", "y"]).groupBy(*keys, "seg").agg(F.min("owner").alias("owner"))


def link_rounds(
    segments: DataFrame, stems: DataFrame, forced: DataFrame, labelled: DataFrame, keys: Sequence[str],
    spacing: float, extent: int, gate: bool = True,
) -> DataFrame:
    """(keys, seg, owner, parent_x, parent_y) of every rooted segment.

    Segments touching earlier owners keep them. Others take the cheapest owned parent above
    them; a segment waits while a cheaper candidate is still open. Fragments without an owned
    candidate stay unowned. ``stems`` has (keys, owner, x, y).
    """
    keys = list(keys)
    # Open segments whose upper ends agree have the same candidates and are decided as one; only a segment that does
    # not descend could meet its own lower end, and stays alone. Without the gate every part fits any other.
    part = F.col("component").cast("long") if gate else F.lit(None).cast("long")
    flat = F.col("lower_y") <= F.col("upper_y")
    same = [*keys, "x", "y", "angle", "_part", "_self"]
    tops = segments.join(forced.select(*keys, "seg"), [*keys, "seg"], "left_anti").select(
        *keys, "seg", F.col("upper_x").alias("x"), F.col("upper_y").alias("y"), F.col("upper_angle").alias("angle"),
        F.coalesce(part, F.lit(NOTHING)).alias("_part"), F.coalesce(F.when(flat, F.col("seg")), F.lit(NOTHING)).alias("_self"))
    classes = cut(tops.groupBy(*same).agg(F.min("seg").alias("child")), "classes")
    members = cut(tops.join(classes, same).select(*keys, "seg", "child"), "members")
    children = classes.select(*keys, "child", "x", "y", "angle", F.when(F.col("_part") != NOTHING, F.col("_part")).alias("part"))
    # Stems take negative ids, so they can never collide with pixel codes.
    roots = stems.select(*keys, (-1 - F.col("owner")).cast("long").alias("seg"), F.col("owner").cast("int").alias("owner"), "x", "y")
    given = cut(
        roots.select(*keys, "seg", "owner").unionByName(forced.select(*keys, "seg", F.col("owner").cast("int").alias("owner"))), "owned")
    lower = segments.where("not lower_is_tip").select(
        *keys, "seg", F.col("lower_x").alias("x"), F.col("lower_y").alias("y"), F.col("lower_angle").alias("angle"), F.lit(False).alias("is_stem"),
        part.alias("part"), flat.alias("flat"))
    ends = lower.unionByName(roots.select(
        *keys, "seg", "x", "y", F.lit(90.0).alias("angle"), F.lit(True).alias("is_stem"), F.lit(None).cast("long").alias("part"), F.lit(False).alias("flat")))
    places = ends.select(*keys, F.col("seg").alias("parent"), F.col("x").alias("parent_x"), F.col("y").alias("parent_y"))
    parents = ends.join(given, [*keys, "seg"], "left").join(members.withColumnRenamed("child", "open"), [*keys, "seg"], "left")
    parents = cut(parents.where("owner is not null or open is not null").withColumnRenamed("seg", "parent"), "parents")
    pairs, dead = _useful_links(children, parents, keys, spacing)
    if gate:
        rooted = pairs.where("parent_part is null or part is null")
        judged = pairs.where("parent_part is not null and part is not null").withColumnsRenamed({"part": "child_label", "parent_part": "parent_label"})
        judged = gap_gate(judged, labelled, keys).withColumnsRenamed({"child_label": "part", "parent_label": "parent_part"})
        pairs = cut(rooted.unionByName(judged), "gated")
    pairs = pairs.select(*keys, "child", "parent", "open", "owner", "cost")
    rounds = []
    while True:
        best = pairs.groupBy(*keys, "child").agg(
            F.min(F.when(F.col("owner").isNotNull(), F.struct("cost", "parent", "owner"))).alias("_b"),
            F.min(F.when(F.col("owner").isNull(), F.col("cost"))).alias("_wait"),
        )
        won = best.where("_b is not null and (_wait is null or _b.cost <= _wait)").select(*keys, "child", F.col("_b.owner").alias("owner"), F.col("_b.parent").alias("parent"))
        # Nothing owned is reachable any more once no open candidate is left either.
        lost = dead.join(pairs.select(*keys, "child").distinct(), [*keys, "child"], "left_anti").select(
            *keys, "child", F.lit(None).cast("int").alias("owner"), F.lit(None).cast("long").alias("parent"))
        decided = cut(won.unionByName(lost), "decided")
        if decided.isEmpty():
            break
        rounds.append(decided.where("owner is not null"))
        dead = cut(dead.join(decided.select(*keys, "child"), [*keys, "child"], "left_anti"), "dead")
        news = decided.select(*keys, F.col("child").alias("open"), F.col("owner").alias("_now"), F.lit(True).alias("_known"))
        # An owner's name makes a candidate usable; a lost one is dropped.
        pairs = cut(pairs.join(decided.select(*keys, "child"), [*keys, "child"], "left_anti").join(news, [*keys, "open"], "left").where(
            "_known is null or _now is not null").select(*keys, "child", "parent", "open", F.coalesce("owner", "_now").alias("owner"), "cost"), "pairs")
    linked = children.select(*keys, "child", F.lit(None).cast("int").alias("owner"), F.lit(None).cast("long").alias("parent")).where("false")
    for found in rounds:
        linked = linked.unionByName(found)
    linked = cut(members.join(linked, [*keys, "child"]).select(*keys, "seg", "owner", "parent"), "linked")
    held = _nearest_owned(given.where("seg >= 0"), given.unionByName(linked.select(*keys, "seg", "owner")), segments, places, keys)
    return linked.join(places, [*keys, "parent"], "left").select(*keys, "seg", "owner", "parent", "parent_x", "parent_y").unionByName(held)


def _useful_links(children: DataFrame, parents: DataFrame, keys: Sequence[str], spacing: float) -> tuple[DataFrame, DataFrame]:
    """The candidates that can decide a child or make it wait, and the children (keys, child) that no owner can reach surely.

    A candidate that is owned, or is sure to be, will be preferred to all that cost more: neither do they win, nor does the
    child wait for them. So no child needs candidates beyond the cheapest of these. Children without any keep all.
    """
    usable = parents.where("owner is not null")
    rest, bounds = cut(children, "children"), []
    while True:
        bound = matching.cheapest_cost(rest, usable, keys, spacing)
        rest = cut(rest.join(bound.select(*keys, "child"), [*keys, "child"], "left_anti"), "rest")
        bound = cut(bound, "reached")
        bounds.append(bound)
        if rest.isEmpty() or bound.isEmpty():
            break
        usable = parents.join(bound.select(*keys, F.col("child").alias("open")), [*keys, "open"], "left_semi")
    known = bounds[0]
    for bound in bounds[1:]:
        known = known.unionByName(bound)
    pairs = matching.links_up_to(children.join(known, [*keys, "child"], "left"), parents, keys, spacing)
    return cut(pairs, "pairs"), rest.select(*keys, "child")


def _nearest_owned(held, owned, segments, places, keys) -> DataFrame:
    """Parents of segments kept by history: nearest earlier end of the same owner, by Manhattan distance, the smaller parent first.

    Earlier is what begins higher up; a stem is earlier than what begins inside the image.
    """
    tops = segments.select(*keys, "seg", F.col("upper_x").alias("x"), F.col("upper_y").alias("y"))
    own = cut(held.select(*keys, "seg", "owner").join(tops, [*keys, "seg"]), "held")
    ends = owned.select(*keys, F.col("seg").alias("parent"), "owner").join(places, [*keys, "parent"]).join(
        segments.select(*keys, F.col("seg").alias("parent"), F.col("upper_y").alias("_top")), [*keys, "parent"], "left"
    ).select(*keys, "owner", "parent", F.col("parent_x").alias("x"), F.col("parent_y").alias("y"), (F.coalesce("_top", F.lit(-1)) + 1).alias("after"))
    found = nearest(own, ends, [*keys, "owner"], rank="parent", gate="after", manhattan=True)
    return own.join(found, [*keys, "owner", "x", "y"], "left").select(
        *keys, "seg", "owner", "parent", F.col("tx").alias("parent_x"), F.col("ty").alias("parent_y"))


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment of rows to columns for a small matrix (Kuhn, 1955)."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    rows, cols = cost.shape
    price_r, price_c, owner = np.zeros(rows), np.zeros(cols), np.full(cols, -1)
    for row in range(rows):
        slack, back = np.full(cols, np.inf), np.full(cols, -1)
        done = np.zeros(cols, bool)
        current, column = row, -1
        while True:
            reduced = cost[current] - price_r[current] - price_c
            better = ~done & (reduced < slack)
            slack[better], back[better] = reduced[better], column
            column = int(np.argmin(np.where(done, np.inf, slack)))
            step = slack[column]
            price_r[row] += step
            for c in np.flatnonzero(done):
                price_r[owner[c]] += step
            price_c[done] -= step
            slack[~done] -= step
            done[column] = True
            if owner[column] < 0:
                break
            current = owner[column]
        while column >= 0:
            before = back[column]
            owner[column] = row if before < 0 else owner[before]
            column = before
    return sorted((int(r), c) for c, r in enumerate(owner) if r >= 0)


def _route_junction(pdf: pd.DataFrame) -> pd.DataFrame:
    """Owners of the exits of one junction: least total turn, order breaks ties.

    ``why`` is 0 for an owner that an exit is assigned to. With fewer exits than owners the others ask to share the
    exit that suits them best (1); where a bundle arrives alone, every owner asks to share every exit (2).
    """
    arrivals = pdf[pdf["kind"] == "in"].sort_values(["x", "seg", "offset", "owner"], kind="stable")
    exits = pdf[pdf["kind"] == "out"].sort_values(["x", "lower_x", "seg"], kind="stable").reset_index(drop=True)
    owners = list(dict.fromkeys(arrivals["owner"].astype(int)))
    score = np.zeros((len(owners), len(exits)))
    choice = {}
    for r, owner in enumerate(owners):
        mine = arrivals[arrivals["owner"] == owner]
        for c, (_, leave) in enumerate(exits.iterrows()):
            turns = np.abs((leave["angle"] - mine["angle"].to_numpy() + 180.0) % 360.0 - 180.0)
            k = int(np.argmin(turns))
            choice[r, c] = mine.iloc[k]
            score[r, c] = turns[k] + abs(r / max(1, len(owners) - 1) - c / max(1, len(exits) - 1)) * ORDER_WEIGHT
            if pd.notna(leave["support_owner"]) and int(leave["support_owner"]) != owner:
                score[r, c] += FOREIGN_WEIGHT * leave["share"]
    alone = arrivals["seg"].nunique() == 1
    if alone and arrivals["parallel"].eq(True).any() and len(exits) == len(owners):
        # Lanes of a parallel bundle keep their order; their old headings may point across each other.
        lanes = np.abs(np.arange(len(owners))[:, None] - np.arange(len(exits)))
        foreign = [[leave["share"] if pd.notna(leave["support_owner"]) and int(leave["support_owner"]) != o else 0.0 for _, leave in exits.iterrows()] for o in owners]
        score = lanes + FOREIGN_WEIGHT * np.array(foreign)
    pairs = assign(score)
    taken_rows, taken_cols = {r for r, _ in pairs}, {c for _, c in pairs}
    why = {p: 0 for p in pairs}
    why |= {(r, int(np.argmin(score[r]))): 1 for r in range(len(owners)) if r not in taken_rows and len(exits)}
    why |= {(int(np.argmin(score[:, c])), c): 0 for c in range(len(exits)) if c not in taken_cols}
    if alone and len(owners) > 1 and arrivals["bundle"].eq(True).any():
        why |= {(r, c): 2 for r in range(len(owners)) for c in range(len(exits)) if (r, c) not in why}
    counts = arrivals.groupby("owner")["seg"].nunique()
    out = [
        (exits.iloc[c]["seg"], owners[r], choice[r, c]["seg"], choice[r, c]["px"], choice[r, c]["py"], choice[r, c]["angle"], kind, int(counts[owners[r]]), len(exits))
        for (r, c), kind in why.items()
    ]
    frame = pd.DataFrame(out, columns=["seg", "owner", "parent", "parent_x", "parent_y", "angle", "why", "routes", "exits"])
    for name in pdf.columns:
        if name not in ("kind", "seg", "owner", "x", "lower_x", "angle", "px", "py", "support_owner", "share", "offset", "bundle", "parallel"):
            frame.insert(0, name, pdf[name].iloc[0])
    return frame


def route(
    segments: DataFrame, base: DataFrame, stems: DataFrame, support: DataFrame, keys: Sequence[str], points: DataFrame | None = None
) -> DataFrame:
    """(keys, seg, owner, parent, parent_x, parent_y, angle, until): owners after junction routing.

    Junctions whose arrivals are all decided form a wave and are solved side by side, each as a
    tiny assignment. Away from junctions a segment inherits the owners of its base parent. When
    arrivals wait for each other, the highest usable task of a group of tasks that wait for none but
    each other is released with its base links. ``support`` has (keys, seg, support_owner, share).

    With ``points`` (keys, seg, pos, x, y, width) owners that find no exit of their own share one only
    on evidence: exits of their own beyond it, or the width of a bundle. An owner that ends where a
    bundle narrows holds the points before ``until`` and does not go on. Without points, or where a
    width is missing, such owners share.
    """
    keys = list(keys)
    whole = F.lit(None).cast("int").alias("until")
    flows = cut(
        stems.select(
            *keys, (-1 - F.col("owner")).cast("long").alias("seg"), F.col("owner").cast("int").alias("owner"),
            F.lit(None).cast("long").alias("parent"), F.lit(None).cast("int").alias("parent_x"), F.lit(None).cast("int").alias("parent_y"),
            F.lit(90.0).alias("angle"), whole,
        ),
        "flows",
    )
    first_parent = base.groupBy(*keys, "seg").agg(F.min(F.struct("parent", "parent_x", "parent_y")).alias("_p"))
    todo = cut(
        segments.select(*keys, "seg", "upper_x", "upper_y", "lower_x", "upper_junction", ((F.col("upper_angle") + 180.0) % 360.0).alias("leave"))
        .join(support, [*keys, "seg"], "left")
        .join(first_parent.select(*keys, "seg", F.col("_p.parent").alias("base"), F.col("_p.parent_x").alias("base_x"), F.col("_p.parent_y").alias("base_y")), [*keys, "seg"], "left"),
        "todo",
    )
    lowers = segments.select(*keys, "seg", "lower_x", "lower_y", "lower_angle", "lower_junction")
    contact = None if points is None else Contacts(segments, points, support, keys)
    release = tried = None
    while not todo.isEmpty():
        waiting = todo.select(*keys, "seg")
        arriving = lowers.where("lower_junction is not null").select(*keys, "seg", "lower_x", "lower_y", F.col("lower_junction").alias("junction"))
        blocked = arriving.join(waiting, [*keys, "seg"], "left_semi").select(*keys, "junction").distinct()
        exits = todo.where("upper_junction is not null").withColumn("junction", F.col("upper_junction"))
        ready = exits.join(blocked, [*keys, "junction"], "left_anti")
        incoming = arriving.join(flows.where("until is null").select(*keys, "seg", "owner", "angle"), [*keys, "seg"])
        if contact is None:
            incoming = incoming.select("*", F.lit(0.0).alias("offset"), F.lit(False).alias("bundle"), F.lit(False).alias("parallel"))
        else:
            incoming = incoming.join(contact.sections.select(*keys, "seg", "owner", "offset", "bundle", "parallel"), [*keys, "seg", "owner"], "left")
        ready, incoming = cut(ready, "ready"), cut(incoming, "incoming")
        physical = ready.join(incoming.select(*keys, "junction").distinct(), [*keys, "junction"], "left_semi")
        shape = lambda df, kind, **c: df.select(
            *keys, "junction", F.lit(kind).alias("kind"), F.col("seg"), c["owner"].cast("int").alias("owner"), c["x"].cast("int").alias("x"),
            c["lower_x"].cast("int").alias("lower_x"), c["angle"].cast("double").alias("angle"), c["px"].cast("int").alias("px"), c["py"].cast("int").alias("py"),
            c["support_owner"].cast("int").alias("support_owner"), c["share"].cast("double").alias("share"),
            c["offset"].cast("double").alias("offset"), c["bundle"].cast("boolean").alias("bundle"), c["parallel"].cast("boolean").alias("parallel"),
        )
        null = F.lit(None)
        tasks = shape(
            incoming.join(physical.select(*keys, "junction").distinct(), [*keys, "junction"], "left_semi"), "in", owner=F.col("owner"), x=F.col("lower_x"),
            lower_x=null, angle=F.col("angle"), px=F.col("lower_x"), py=F.col("lower_y"), support_owner=null, share=null,
            offset=F.col("offset"), bundle=F.col("bundle"), parallel=F.col("parallel"),
        ).unionByName(
            shape(physical, "out", owner=null, x=F.col("upper_x"), lower_x=F.col("lower_x"), angle=F.col("leave"), px=null, py=null,
                  support_owner=F.col("support_owner"), share=F.col("share"), offset=null, bundle=null, parallel=null)
        )
        routed = tasks.groupBy(*keys, "junction").applyInPandas(_route_junction, _route_schema(segments, keys)).drop("junction")
        if contact is None:
            routed = routed.where("why < 2").select(*keys, "seg", "owner", "parent", "parent_x", "parent_y", "angle", whole)
        else:
            routed = contact.judge(cut(routed, "routed"))
        # Without a physical arrival the base link decides, as soon as its parent is decided.
        loose = todo.where("upper_junction is null").unionByName(
            ready.join(incoming.select(*keys, "junction").distinct(), [*keys, "junction"], "left_anti").drop("junction")
        )
        if release is not None:
            loose = loose.unionByName(todo.join(release, [*keys, "seg"], "left_semi")).distinct()
        settled = loose.join(waiting.select(*keys, F.col("seg").alias("base")), [*keys, "base"], "left_anti")
        inherited = settled.join(
            flows.where("until is null").select(*keys, F.col("seg").alias("base"), "owner", "angle"), [*keys, "base"]
        ).select(*keys, "seg", "owner", F.col("base").alias("parent"), F.col("base_x").alias("parent_x"), F.col("base_y").alias("parent_y"), "angle", whole)
        decided = cut(physical.select(*keys, "seg").unionByName(settled.select(*keys, "seg")).distinct(), "decided")
        if decided.isEmpty():
            # What was released and decided nothing stays back until something else is decided.
            if release is not None:
                tried = release if tried is None else tried.unionByName(release)
            release = released_tasks(todo, lowers, tried, keys)
            if release.isEmpty():
                break
            continue
        routes = cut(routed.unionByName(inherited), "routes")
        fresh = cut(_publish(routes, todo, flows, lowers, decided, keys, None if contact is None else contact.upgrades), "fresh")
        if contact is not None:
            contact.remember(fresh)
        release = tried = None
        flows = cut(flows.unionByName(fresh), "flows")
        todo = cut(todo.join(decided, [*keys, "seg"], "left_anti"), "todo")
    return flows.where("seg >= 0")


class Contacts:
    """What contacts have shown so far: carried sections, and the evidence for sharing an exit."""

    def __init__(self, segments: DataFrame, points: DataFrame, support: DataFrame, keys: Sequence[str]):
        self.keys, self.segments = list(keys), segments
        self.profile = cut(contacts.profiles(points, keys), "profiles")
        self.lengths = self.profile.select(*keys, "seg", contacts.path_length(F.col("path")).alias("length"))
        self.history = support.where("support_owner is not null").select(*keys, "seg", F.col("support_owner").cast("int").alias("owner"))
        self.tangents = cut(contact_tangents(points, segments, keys), "tangents")
        self.proven = self.upgrades = None
        kinds = dict(segments.dtypes)
        named = ", ".join(f"`{k}` {kinds[k]}" for k in self.keys)
        self.sections = segments.sparkSession.createDataFrame(
            [], f"{named}, seg bigint, owner int, width double, offset double, bundle boolean, parallel boolean, travelled double")

    def judge(self, routed: DataFrame) -> DataFrame:
        """Routes without the requests to share that nothing supports, and with the points up to which owners go."""
        keys, at = self.keys, [*self.keys, "seg"]
        asking = routed.where("why > 0").select(*at).distinct()
        if asking.isEmpty():
            self.proven = self.upgrades = None
            return routed.select(*at, "owner", "parent", "parent_x", "parent_y", "angle", F.lit(None).cast("int").alias("until"))
        measured = asking.join(self.profile.where("widths is not null").select(*at), at, "left_semi")
        options = contacts.arrival_sections(routed.join(measured, at, "left_semi"), self.sections, self.segments, self.profile, keys)
        options = cut(options, "options")
        lonely = options.where("why = 1").select(*at).distinct()
        free = contacts.independent_exits(
            options.join(lonely, at, "left_semi").select(*at, "owner", "angle", "routes", "width"), self.segments, self.lengths, self.history, keys)
        several = free.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*at)
        free = cut(free.join(several, at, "left_semi"), "independent")
        bundles = self.sections.where("bundle").select(*keys, F.col("seg").alias("parent"), F.lit(True).alias("_b")).distinct()
        rows = options.join(several, at, "left_anti").join(bundles, [*keys, "parent"], "left").groupBy(*at).agg(
            F.array_sort(F.collect_list(F.struct("center", "owner", "width"))).alias("_o"), F.min(F.when(F.col("why") == 0, F.col("owner"))).alias("winner"),
            F.coalesce(F.max("_b"), F.lit(False)).alias("inherited"))
        rows = rows.join(self.profile, at).withColumn("options", F.transform("_o", lambda o: F.struct(o["owner"].alias("owner"), o["width"].alias("width"), o["center"].alias("center"))))
        widest = F.array_max(F.transform("options", lambda o: o["width"]))
        need = 2 * F.greatest(F.lit(1), F.rint(F.coalesce(widest, F.lit(1.0)) / F.greatest(contacts.spacing(F.col("path")), F.lit(contacts.TINY))).cast("int"))
        ahead = contacts.looked_ahead(rows.drop("_o").withColumn("need", need), self.segments, self.profile, keys)
        extents = cut(contacts.width_support(ahead, keys).join(self.profile.select(*at, F.size("path").alias("_n")), at), "extents")
        self.proven = extents.select(*at)
        # Evidence, or a corridor whose width nobody measured.
        unknown = asking.join(measured, at, "left_anti").select(*at, F.lit(True).alias("_unknown"))
        judged = routed.join(free.select(*at, "owner", F.lit(True).alias("_free")), [*at, "owner"], "left").join(extents, at, "left").join(unknown, at, "left")
        kept = judged.where("why = 0 or _free or cut is not null or (_unknown and why = 1)")
        ends = F.when((F.col("cut") < F.col("_n")) & (F.col("owner") != F.col("survivor")), F.col("cut")).cast("int")
        self.upgrades = cut(kept.where("_free or cut is not null").select(*at, "owner"), "upgrades")
        return self._exclusive(kept.select(*at, "owner", "parent", "parent_x", "parent_y", "angle", "exits", ends.alias("until")), routed)

    def _exclusive(self, kept: DataFrame, routed: DataFrame) -> DataFrame:
        """At a lone exit that one owner gets, the owner that goes on most straight, measured outside the contact."""
        keys, at = self.keys, [*self.keys, "seg"]
        single = kept.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"), F.max("exits").alias("_e")).where("_n = 1 and _e = 1").select(*at)
        rivals = routed.join(single, at, "left_semi").join(self.history.select(*at), at, "left_anti")
        clear = rivals.groupBy(*at).agg(
            F.count(F.lit(1)).alias("_n"), F.count_distinct("parent").alias("_p"), F.max("routes").alias("_r")).where("_n > 1 and _n = _p and _r = 1").select(*at)
        inward = self.tangents.select(*keys, F.col("seg").alias("parent"), "inward")
        outward = self.tangents.select(*at, "outward")
        scored = rivals.join(clear, at, "left_semi").join(inward, [*keys, "parent"], "left").join(outward, at).withColumn("inward", F.coalesce("inward", "angle"))
        best = least_turn(scored, at, "owner", "inward", "outward").select(*at, "owner")
        changed = rivals.join(best, [*at, "owner"])
        columns = [*at, "owner", "parent", "parent_x", "parent_y", "angle"]
        return kept.join(changed.select(*at), at, "left_anti").select(*columns, "until").unionByName(
            changed.select(*columns, F.lit(None).cast("int").alias("until")))

    def remember(self, fresh: DataFrame) -> None:
        """Sections of shared segments; what a single owner hands on is the width of its own segment anyway."""
        at = [*self.keys, "seg"]
        shared = fresh.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*at)
        if shared.isEmpty():
            return
        routes = fresh.where("parent is not null").join(shared, at, "left_semi")
        proven = shared.where("false") if self.proven is None else self.proven
        found = contacts.carried_sections(routes, self.sections, self.segments, self.profile, proven, self.keys)
        self.sections = cut(self.sections.unionByName(found.select(*self.sections.columns)), "sections")


def contact_tangents(points: DataFrame, segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, seg, inward, outward): directions at the lower and the upper end, measured off their junctions.

    A line is fitted between one and two diameters from the end. Ends without a junction, and segments too short to
    have an interior, keep the direction of the end itself.
    """
    at = [*keys, "seg"]
    stepped = next_point(points, at, "pos", "x", "y")
    order = Window.partitionBy(*at).orderBy("pos")  # a segment's points are bounded by its image
    step = F.coalesce(F.hypot(F.col("_nx") - F.col("x"), F.col("_ny") - F.col("y")), F.lit(0.0))
    arcs = stepped.withColumn("_step", step).withColumn("_narc", F.sum("_step").over(order)).withColumn("_arc", F.col("_narc") - F.col("_step"))
    facts = points.groupBy(*at).agg(F.percentile("width", F.lit(0.5)).alias("_d")).join(
        arcs.groupBy(*at).agg(F.max("_narc").alias("_len")), at).join(segments.select(*at, "upper_angle", "lower_angle", "upper_junction", "lower_junction"), at)
    upper, lower = F.col("upper_junction").isNotNull(), F.col("lower_junction").isNotNull()
    room = F.when(upper & lower, 3.0).otherwise(2.0) * F.col("_d")
    long = (F.col("_d") > 0) & (F.col("_len") >= room)
    pieces = cut(arcs.where("_step > 0").join(facts.where(long).select(*at, "_d", "_len"), at), "arms")
    out = facts
    for name, low, high in (("_out", F.col("_d"), 2 * F.col("_d")), ("_in", F.col("_len") - 2 * F.col("_d"), F.col("_len") - F.col("_d"))):
        out = out.join(line_direction(pieces, at, "_arc", low, high).withColumnRenamed("direction", name), at, "left")
    return out.select(
        *at, F.when(lower, F.coalesce("_in", "lower_angle")).otherwise(F.col("lower_angle")).alias("inward"),
        F.when(upper, F.coalesce("_out", F.pmod(F.col("upper_angle") + 180.0, F.lit(360.0)))).otherwise(F.pmod(F.col("upper_angle") + 180.0, F.lit(360.0))).alias("outward"))


def released_tasks(todo: DataFrame, lowers: DataFrame, tried: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """(keys, seg): the segments of one task per group to be decided by base links when arrivals wait for each other.

    A task is a junction's exits or a segment without one. Of the tasks that wait, a strongly connected group that
    waits for no other one is found by forward and backward reachability (Fleischer et al., 2000); its highest task
    with a base link that is decided is released. Groups of tasks without any are passed over.
    """
    keys = list(keys)
    name = F.coalesce(F.col("upper_junction"), -1 - F.col("seg"))
    open_ = todo if tried is None else todo.join(tried, [*keys, "seg"], "left_anti")
    tasks = cut(open_.select(*keys, "seg", name.alias("task"), "upper_junction", "base", "upper_y", "upper_x"), "tasks")
    waiting = todo.select(*keys, F.col("seg").alias("base"), F.lit(True).alias("_waits"))
    usable = cut(tasks.join(waiting, [*keys, "base"], "left").where("_waits is null").groupBy(*keys, "task").agg(
        F.min(F.struct("upper_y", "upper_x", "seg")).alias("_place")), "usable")
    of = tasks.select(*keys, F.col("seg").alias("_seg"), F.col("task").alias("to"))
    by_arrival = tasks.where("upper_junction is not null").select(*keys, "task", F.col("upper_junction").alias("lower_junction")).distinct().join(
        lowers.where("lower_junction is not null").select(*keys, "lower_junction", F.col("seg").alias("_seg")), [*keys, "lower_junction"])
    by_base = tasks.where("base is not null").select(*keys, "task", F.col("base").alias("_seg"))
    edges = cut(by_arrival.select(*keys, "task", "_seg").unionByName(by_base).join(of, [*keys, "_seg"]).select(*keys, "task", "to").where("task <> to").distinct(), "waits")

    def reached(start, arcs):
        known = front = start
        while True:
            front = cut(front.join(arcs, [*keys, "task"]).select(*keys, F.col("to").alias("task")).distinct().join(known, [*keys, "task"], "left_anti"), "front")
            if front.isEmpty():
                return known
            known = cut(known.unionByName(front), "known")

    chosen, left = None, cut(tasks.select(*keys, "task").distinct(), "left")
    while not left.isEmpty():
        inside = edges.join(left, [*keys, "task"], "left_semi").join(left.withColumnRenamed("task", "to"), [*keys, "to"], "left_semi")
        inside = cut(inside.select(*keys, "task", "to"), "inside")
        area = left
        while True:
            pivot = area.groupBy(*keys).agg(F.min("task").alias("task"))
            ahead = reached(pivot, inside)
            back = reached(pivot, inside.join(ahead, [*keys, "task"], "left_semi").select(*keys, F.col("to").alias("task"), F.col("task").alias("to")))
            back = cut(back.join(ahead, [*keys, "task"], "left_semi"), "back")
            deeper = ahead.join(back, [*keys, "task"], "left_anti")
            # Groups whose strongly connected set waits for nothing else keep it; the others look further upstream.
            more = deeper.select(*keys).distinct()
            area = cut(deeper.unionByName(back.join(more, keys, "left_anti")), "area")
            if more.isEmpty():
                break
        group = usable.join(area, [*keys, "task"]).groupBy(*keys).agg(F.min_by("task", "_place").alias("task"))
        chosen = cut(group if chosen is None else chosen.unionByName(group), "chosen")
        left = cut(left.join(area, [*keys, "task"], "left_anti").join(chosen.select(*keys), keys, "left_anti"), "left")
    if chosen is None:
        return tasks.select(*keys, "seg")
    return cut(tasks.join(chosen, [*keys, "task"], "left_semi").select(*keys, "seg"), "release")


def undecided(segments: DataFrame, routed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, seg) of segments that routing could not decide: no owner arrives and no base link helps."""
    return segments.select(*keys, "seg").join(routed.select(*keys, "seg"), [*keys, "seg"], "left_anti")


def _route_schema(segments, keys) -> str:
    kinds = dict(segments.dtypes)
    named = [f"`{k}` {kinds[k]}" for k in keys]
    # _route_junction puts the key columns first, in reverse order of appearance.
    head = ", ".join(["junction bigint", *reversed(named)])
    return f"{head}, seg bigint, owner int, parent bigint, parent_x int, parent_y int, angle double, why int, routes int, exits int"


def _publish(routes, todo, flows, lowers, decided, keys, upgrades=None) -> DataFrame:
    """Apply earlier evidence to freshly routed owners.

    On a segment with an established owner, others stay only when an exit beyond it is theirs or a contact
    has proven them (``upgrades``: keys, seg, owner);
    an established owner that did not arrive is restored from its nearest flow above.
    """
    facts = todo.select(*keys, "seg", "support_owner", "share", "upper_x", "upper_y")
    beyond = lowers.where("lower_junction is not null").select(*keys, "seg", F.col("lower_junction").alias("upper_junction")).join(
        todo.where("support_owner is not null").select(*keys, "upper_junction", F.col("support_owner").alias("owner")).distinct(), [*keys, "upper_junction"]
    ).select(*keys, "seg", "owner", F.lit(True).alias("_proven")).distinct()
    if upgrades is not None:
        beyond = beyond.unionByName(upgrades.select(*keys, "seg", "owner", F.lit(True).alias("_proven"))).distinct()
    kept = cut(routes.join(facts, [*keys, "seg"]).join(beyond, [*keys, "seg", "owner"], "left").where(
        "support_owner is null or support_owner = owner or _proven"
    ).select(*routes.columns), "kept")
    have = kept.select(*keys, "seg", "owner")
    # A fragment nothing reaches needs majority support; any reached one keeps its old owner.
    reached = routes.select(*keys, "seg").distinct().withColumn("_reached", F.lit(True))
    missing = cut(facts.join(decided, [*keys, "seg"], "left_semi").where("support_owner is not null").join(reached, [*keys, "seg"], "left").where("_reached or share >= 0.5").select(
        *keys, "seg", F.col("support_owner").cast("int").alias("owner"), "upper_x", "upper_y"
    ).join(have, [*keys, "seg", "owner"], "left_anti"), "missing")
    spots = flows.where("until is null").join(lowers.select(*keys, "seg", F.col("lower_x").alias("fx"), F.col("lower_y").alias("fy")), [*keys, "seg"]).select(
        *keys, F.col("seg").alias("parent"), "owner", "fx", "fy", "angle"
    )
    # The nearest flow of the owner that ends no deeper than the fragment begins, the smaller segment first.
    found = nearest(
        missing.select(*keys, "owner", F.col("upper_x").alias("x"), F.col("upper_y").alias("y")),
        spots.select(*keys, "owner", "parent", F.col("fx").alias("x"), F.col("fy").alias("y")), [*keys, "owner"], above=True, rank="parent")
    headings = spots.groupBy(*keys, "owner", "parent").agg(F.min("angle").alias("angle"))
    restored = missing.join(found.withColumnsRenamed({"x": "upper_x", "y": "upper_y"}), [*keys, "owner", "upper_x", "upper_y"]).join(
        headings, [*keys, "owner", "parent"]).select(
        *keys, "seg", "owner", "parent", F.col("tx").alias("parent_x"), F.col("ty").alias("parent_y"), "angle", F.lit(None).cast("int").alias("until"))
    every = kept.unionByName(restored)
    # A single owner leaves along the segment's own direction, shared owners keep theirs.
    count = every.where("until is null").groupBy(*keys, "seg").agg(F.count_distinct("owner").alias("_n"))
    best = every.groupBy(*keys, "seg", "owner").agg(F.min_by(F.struct("parent", "parent_x", "parent_y", "angle", "until"), F.struct("angle", "parent")).alias("_b"))
    return best.join(count, [*keys, "seg"], "left").join(lowers.select(*keys, "seg", "lower_angle"), [*keys, "seg"]).select(
        *keys, "seg", "owner", F.col("_b.parent").alias("parent"), F.col("_b.parent_x").alias("parent_x"), F.col("_b.parent_y").alias("parent_y"),
        F.when(F.col("_n") > 1, F.col("_b.angle")).otherwise(F.col("lower_angle")).alias("angle"), F.col("_b.until").alias("until"),
    )


def has_axis(main_points: DataFrame, who: Sequence[str]) -> DataFrame:
    """Owners whose first main geometry is longer than it is wide."""
    return main_points.groupBy(*who).agg(
        F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_extent"), F.percentile("width", F.lit(0.5)).alias("_width")
    ).where("_extent > _width").select(*who)
