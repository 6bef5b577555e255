"""Evidence at contacts: does a corridor hold one root or several, and where do they part.

A corridor is a segment below a junction at which several owners arrive. Profiles are arrays along a segment (``path``
of points, ``widths`` of measured diameters), which a segment's pixels bound; everything is computed in the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from phenoframe.functions.angles import turn
from phenoframe.operators.forest import chain_totals
from phenoframe.runtime import cut

TINY = 2.0 ** -52


def profiles(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, seg, path, widths) of points (keys, seg, pos, x, y, width). Segments with an unmeasured point have null widths."""
    rows = points.groupBy(*keys, "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "width"))).alias("_p"))
    whole = ~F.exists("_p", lambda p: p["width"].isNull())
    return rows.select(
        *keys, "seg", F.transform("_p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("path"),
        F.when(whole, F.transform("_p", lambda p: p["width"].cast("double"))).alias("widths"))


def median(values: Column) -> Column:
    """Median of an array of numbers; null if it is empty."""
    n = F.size(values)
    ordered = F.array_sort(values)
    return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2.0)


def _part(values: Column, start: Column, count: Column) -> Column:
    """``count`` items from zero-based ``start``, as far as there are any."""
    return F.slice(values, start + 1, F.greatest(count, F.lit(0)))


def interior_width(widths: Column) -> Column:
    """Median width of the middle half of a segment, away from the bulges at its ends."""
    n = F.size(widths)
    first = F.floor(n / 4).cast("int")
    return median(_part(widths, first, F.greatest(first + 1, F.floor(3 * n / 4).cast("int")) - first))


def path_length(path: Column) -> Column:
    return F.aggregate(_steps(path), F.lit(0.0), lambda a, s: a + s)


def _steps(path: Column) -> Column:
    n = F.size(path)
    pairs = F.arrays_zip(F.slice(path, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(path, 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    return F.transform(pairs, lambda p: F.hypot((p["b"]["x"] - p["a"]["x"]).cast("double"), (p["b"]["y"] - p["a"]["y"]).cast("double")))


def spacing(path: Column) -> Column:
    """Usual distance of neighbouring points."""
    return F.when(F.size(path) > 1, median(_steps(path))).otherwise(1.0)


def smoothed(values: Column, radius: Column) -> Column:
    """Running median over 2 * radius + 1 values; beyond the ends the end value repeats."""
    last = F.size(values) - 1
    def at(i):
        around = F.transform(F.sequence(i - radius, i + radius), lambda j: F.get(values, F.greatest(F.lit(0), F.least(j, last))))
        return F.get(F.array_sort(around), radius)

    return F.transform(F.sequence(F.lit(0), last), at)


def width_support(corridors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, seg, cut, survivor): corridors whose measured width is that of a bundle.

    ``corridors``: keys, seg, path, widths, measured (widths, with those of the segments that continue an established
    bundle), options (array of owner, width, center across the corridor, in transverse order), winner (the owner that
    holds it anyway) and inherited (an option arrives from an established bundle). The roots share the corridor up to
    point ``cut``; from there on ``survivor`` goes on alone. No row: one root explains the width as well, a width is
    unknown, or the corridor is too short for a judgement.
    """
    c = F.col
    known = corridors.where(
        c("widths").isNotNull() & (F.size("widths") > 0) & (F.size("options") > 0) & ~F.exists("options", lambda o: o["width"].isNull())
        & F.exists("options", lambda o: o["owner"] == c("winner")))
    rows = known.select(
        *keys, "seg", "path", "measured", "options", "winner", "inherited", F.size("path").alias("_n"), spacing(c("path")).alias("_spacing"),
        (F.array_max(F.transform("options", lambda o: o["center"] + o["width"] / 2)) - F.array_min(F.transform("options", lambda o: o["center"] - o["width"] / 2))).alias("_bundle"),
        F.array_max(F.transform("options", lambda o: o["width"])).alias("_widest"),
        F.get(F.filter("options", lambda o: o["owner"] == c("winner")), F.lit(0))["width"].alias("_single"))
    rows = cut(rows, "envelopes")
    rows = rows.withColumn("_r", F.greatest(F.lit(1), F.rint(c("_widest") / F.greatest(c("_spacing"), F.lit(TINY))).cast("int")))
    # Written out, so that the smoothed profile is computed once and not in every expression that uses it.
    rows = cut(rows.withColumn("_m", smoothed(c("measured"), c("_r"))), "smoothed").withColumn("_size", F.size("_m"))
    first = F.when(c("inherited") & (c("_n") < 2 * c("_r")), _part(c("_m"), F.lit(0), c("_r"))).otherwise(_part(c("_m"), c("_r"), c("_r")))
    rows = rows.withColumn("_first", first).where(F.size("_first") >= c("_r"))
    rows = rows.withColumns({
        "_shared": median(F.transform("_first", lambda w: F.abs(w - c("_bundle")))),
        "_alone": median(F.transform("_first", lambda w: F.greatest(F.lit(0.0), F.abs(w - c("_single")) - c("_spacing"))))}).where("_shared < _alone")
    many = F.greatest(c("_r"), F.floor(c("_size") / 4).cast("int"))
    rows = rows.withColumn("_tail", median(_part(c("_m"), F.greatest(c("_size") - many, F.lit(0)), many)))
    rows = rows.withColumn("_best", F.array_min(F.transform("options", lambda o: F.abs(o["width"] - c("_tail")))))
    close = F.filter("options", lambda o: F.abs(F.abs(o["width"] - c("_tail")) - c("_best")) <= 1e-8 + 1e-5 * c("_best"))
    rows = rows.withColumn("_close", close).withColumn("_caliber", F.get("_close", F.lit(0))["width"])
    # The first place from which the width of one root fits better over a whole diameter.
    def count(state, i):
        w = F.get(c("_m"), i)
        run = F.when(F.abs(w - c("_caliber")) < F.abs(w - c("_bundle")), state["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.coalesce(state["at"], F.when(run == c("_r"), i - c("_r") + 1)).alias("at"))

    begin = F.struct(F.lit(0).alias("run"), F.lit(None).cast("int").alias("at"))
    place = F.when(c("_size") - c("_r") > 2 * c("_r"), F.aggregate(F.sequence(2 * c("_r"), c("_size") - 2), begin, count)["at"])
    rows = rows.withColumn("_cut", F.when(c("_best") < F.abs(c("_tail") - c("_bundle")), place))
    rows = cut(rows.withColumn("_cut", F.when(c("_cut") < c("_n"), c("_cut"))), "contractions")
    # Roots of equal caliber: the outer boundary that goes on tells which one does.
    start = F.greatest(F.lit(0), c("_cut") - 2 * c("_r"))
    rows = rows.withColumns({"_before": _part(c("path"), start, c("_cut") - start), "_after": _part(c("path"), c("_cut"), 2 * c("_r"))})
    head, foot = F.get("_before", F.lit(0)), F.get("_before", F.size("_before") - 1)
    rows = rows.withColumns({"_dx": (foot["x"] - head["x"]).cast("double"), "_dy": (foot["y"] - head["y"]).cast("double")})
    norm = F.hypot("_dx", "_dy")

    def mean(points, axis):
        return F.aggregate(points, F.lit(0.0), lambda a, p: a + p[axis]) / F.size(points)

    rows = rows.withColumn("_shift", F.when((norm > 0) & (F.size("_after") >= 2), (
        (mean("_after", "x") - mean("_before", "x")) * -c("_dy") + (mean("_after", "y") - mean("_before", "y")) * c("_dx")) / norm))
    outer = F.array_max(F.transform("_close", lambda o: F.struct((c("_shift") * o["center"]).alias("s"), (-o["owner"]).alias("o"))))
    decided = F.when(F.size("_close") == 1, F.get("_close", F.lit(0))["owner"]).when(F.abs("_shift") >= c("_spacing"), -outer["o"])
    return rows.withColumn("_survivor", F.when(c("_cut").isNotNull(), decided)).select(
        *keys, "seg", F.when(c("_survivor").isNotNull(), c("_cut")).otherwise(c("_n")).alias("cut"), F.coalesce("_survivor", "winner").alias("survivor"))


def looked_ahead(corridors: DataFrame, segments: DataFrame, profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``corridors`` (keys, seg, widths, inherited, need) with ``measured``.

    An inherited bundle in a corridor with fewer than ``need`` widths is followed through its straightest exits, while
    they turn by less than 90 degrees and the widths do not suffice.
    """
    keys = list(keys)
    exits = segments.where("upper_junction is not null").join(profile.where("widths is not null").select(*keys, "seg", "widths"), [*keys, "seg"]).select(
        *keys, F.col("upper_junction").alias("_j"), F.col("seg").alias("_next"), F.col("widths").alias("_w"), F.pmod(F.col("upper_angle") + 180.0, F.lit(360.0)).alias("_leave"))
    lowers = segments.select(*keys, F.col("seg").alias("_at"), F.col("lower_junction").alias("_j"), "lower_angle")
    state = cut(corridors.select("*", F.col("widths").alias("measured"), F.col("seg").alias("_at"), F.array("seg").alias("_seen")), "ahead")
    while True:
        short = state.where(F.col("inherited") & (F.size("measured") < F.col("need")) & F.col("_at").isNotNull())
        if short.isEmpty():
            return state.drop("_at", "_seen")
        found = short.join(lowers, [*keys, "_at"]).join(exits, [*keys, "_j"]).where(~F.array_contains("_seen", F.col("_next"))).groupBy(*keys, "seg").agg(
            F.min(F.struct(turn(F.col("lower_angle"), F.col("_leave")).alias("t"), "_next", "_w")).alias("_b"))
        going = F.col("_b.t") < 90
        moved = short.join(found, [*keys, "seg"], "left").withColumns({
            "_at": F.when(going, F.col("_b._next")), "measured": F.when(going, F.concat("measured", F.col("_b._w"))).otherwise(F.col("measured")),
            "_seen": F.when(going, F.concat("_seen", F.array(F.col("_b._next")))).otherwise(F.col("_seen"))}).drop("_b")
        state = cut(state.join(short.select(*keys, "seg"), [*keys, "seg"], "left_anti").unionByName(moved), "ahead")


def independent_exits(
    options: DataFrame, segments: DataFrame, lengths: DataFrame, history: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """(keys, seg, owner): owners of a corridor that go on in exits of their own at its far end.

    ``options``: keys, seg (the corridor), owner, angle (of its first route), routes (how many it has), width (or
    null); ``segments``: keys, seg, ends, angles and junctions; ``lengths``: keys, seg, length; ``history``: keys, seg,
    owner of segments that were owned before. A corridor goes on through junctions with one arrival and one exit.
    What arrives locally at the far end takes part in the match. An exit counts for the owner whose heading alone is
    nearest to it, within 90 degrees; an old exit only for its old owner. In an established corridor a new exit of
    another owner must lie within the footprint in which two crossing strips overlap.
    """
    keys = list(keys)
    arrivals = segments.where("lower_junction is not null").select(*keys, F.col("lower_junction").alias("_j"), "seg", "lower_x", "lower_y", "lower_angle")
    children = segments.where("upper_junction is not null").select(
        *keys, F.col("upper_junction").alias("_j"), F.col("seg").alias("child"), F.col("upper_x"), F.col("upper_y"),
        F.pmod(F.col("upper_angle") + 180.0, F.lit(360.0)).alias("leave"))
    load = arrivals.groupBy(*keys, "_j").agg(F.count(F.lit(1)).alias("_in")).join(
        children.groupBy(*keys, "_j").agg(F.count(F.lit(1)).alias("_out")), [*keys, "_j"])
    through = load.where("_in = 1 and _out = 1")
    onward = arrivals.join(through, [*keys, "_j"]).join(children, [*keys, "_j"]).select(
        *keys, "seg", F.col("child").alias("_next"), F.hypot(F.col("upper_x") - F.col("lower_x"), F.col("upper_y") - F.col("lower_y")).alias("_gap"))
    steps = lengths.join(onward, [*keys, "seg"], "left").select(*keys, "seg", "_next", (F.col("length") + F.coalesce("_gap", F.lit(0.0))).alias("distance"))
    far, _ = chain_totals(steps, keys, "seg", "_next", ["distance"], top="_last", circles=True)
    corridors = options.select(*keys, "seg").distinct().join(far, [*keys, "seg"]).join(
        arrivals.select(*keys, F.col("seg").alias("_last"), "_j"), [*keys, "_last"]).join(load.where("_out >= 2").select(*keys, "_j"), [*keys, "_j"])
    corridors = cut(corridors, "corridors")
    # Twice the half-widths over the sine of half the angle: how far two crossing strips overlap.
    pair = options.groupBy(*keys, "seg").agg(
        F.count(F.lit(1)).alias("_n"), F.max("routes").alias("_r"), F.count("width").alias("_w"), F.sum("width").alias("_both"),
        F.min("angle").alias("_lo"), F.max("angle").alias("_hi"))
    apart = turn(F.col("_lo"), F.col("_hi"))
    limit = F.when((F.col("_n") == 2) & (F.col("_r") == 1) & (F.col("_w") == 2) & (apart > 0), F.col("_both") / F.sin(F.radians(apart / 2))).otherwise(0.0)
    own = options.join(corridors.select(*keys, "seg", "_j"), [*keys, "seg"]).select(*keys, "seg", "_j", "owner", "angle")
    local = corridors.select(*keys, "seg", "_last", "_j").join(arrivals.select(*keys, "_j", F.col("seg").alias("_other"), "lower_angle"), [*keys, "_j"]).where(
        "_other <> _last").select(*keys, "seg", "_j", F.lit(None).cast(dict(options.dtypes)["owner"]).alias("owner"), F.col("lower_angle").alias("angle"))
    scored = cut(own.unionByName(local).join(children.select(*keys, "_j", "child", "leave"), [*keys, "_j"]).withColumn(
        "_turn", turn(F.col("angle"), F.col("leave"))), "scored")
    best = scored.groupBy(*keys, "seg", "child").agg(F.min("_turn").alias("_best"))
    won = scored.join(best, [*keys, "seg", "child"]).where(F.abs(F.col("_turn") - F.col("_best")) <= 1e-8 + 1e-5 * F.col("_best")).groupBy(*keys, "seg", "child").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_best").alias("_best"), F.min("owner").alias("owner")).where("_n = 1 and _best < 90 and owner is not null")
    before = history.groupBy(*keys, "seg").agg(F.min("owner").alias("_old"))
    judged = won.join(before.withColumnsRenamed({"seg": "child", "_old": "_child_old"}), [*keys, "child"], "left").join(before, [*keys, "seg"], "left").join(
        corridors.select(*keys, "seg", "distance"), [*keys, "seg"]).join(pair.select(*keys, "seg", limit.alias("_limit")), [*keys, "seg"])
    other = F.col("_old").isNotNull() & (F.col("owner") != F.col("_old")) & F.col("_child_old").isNull() & (F.col("distance") > F.col("_limit"))
    return judged.where((F.col("_child_old").isNull() | (F.col("_child_old") == F.col("owner"))) & ~other).select(*keys, "seg", "owner").distinct()


def arrival_sections(routes: DataFrame, sections: DataFrame, segments: DataFrame, profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``routes`` with the ``width`` of each arriving root and its ``center`` across the corridor.

    ``routes``: keys, seg (the corridor), owner, parent (the arriving segment), parent_x, parent_y. A root that
    arrives in a bundle has its width and offset from ``sections`` (keys, seg, owner, width, offset), others the width
    of their own segment. Unknown widths are null.
    """
    keys = list(keys)
    normal = F.radians(F.col("upper_angle") + 180.0)
    held = sections.select(*keys, F.col("seg").alias("parent"), "owner", F.col("width").alias("_w"), "offset")
    own = profile.select(*keys, F.col("seg").alias("parent"), interior_width(F.col("widths")).alias("_own"))
    across = -F.sin(normal) * F.col("parent_x") + F.cos(normal) * F.col("parent_y")
    width = F.coalesce("_w", "_own")
    # Tables by segment look small to the planner where arrays or exploded rows stand behind them; they are never broadcast.
    return routes.join(segments.select(*keys, "seg", "upper_angle").hint("merge"), [*keys, "seg"]).join(
        held.hint("merge"), [*keys, "parent", "owner"], "left").join(own.hint("merge"), [*keys, "parent"], "left").select(
        *routes.columns, width.alias("width"), F.when(width.isNotNull(), across + F.coalesce("offset", F.lit(0.0))).alias("center"))


def carried_sections(
    routes: DataFrame, sections: DataFrame, segments: DataFrame, profile: DataFrame, proven: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """(keys, seg, owner, width, offset, bundle, parallel, travelled) to hand on from decided segments.

    ``routes`` as in :func:`arrival_sections`, with ``angle`` of each route; ``sections`` of earlier waves; ``proven``
    (keys, seg): corridors shown to be bundles by their width. A segment with one owner hands on its own width. In a
    shared one the arriving widths stay, and their offsets from the middle are scaled to the measured silhouette.
    Bundles that have travelled past the footprint in which two crossing strips overlap are ``parallel``, and so is
    what goes on from one. Segments without a measured profile hand on nothing.
    """
    keys = list(keys)
    at = [*keys, "seg"]
    shared = arrival_sections(routes, sections, segments, profile, keys)
    past = sections.groupBy(*keys, F.col("seg").alias("parent")).agg(F.max("parallel").alias("_par"), F.max("travelled").alias("_trav"))
    shared = shared.join(past.hint("merge"), [*keys, "parent"], "left")
    facts = shared.groupBy(*at).agg(
        F.count(F.lit(1)).alias("_n"), F.count("width").alias("_known"), F.min(F.col("center") - F.col("width") / 2).alias("_left"),
        F.max(F.col("center") + F.col("width") / 2).alias("_right"), F.max("width").alias("_widest"), F.sum("width").alias("_all"),
        F.coalesce(F.max("_par"), F.lit(False)).alias("_par"), F.coalesce(F.max("_trav"), F.lit(0.0)).alias("_trav"), F.collect_list("angle").alias("_angles"))
    spread = F.array_max(F.transform("_angles", lambda a: F.array_max(F.transform("_angles", lambda b: turn(a, b)))))
    marked = facts.join(profile.where("widths is not null").hint("merge"), at).join(
        proven.select(*at, F.lit(True).alias("_proof")).distinct().hint("merge"), at, "left")
    window = F.greatest(F.lit(1), F.rint(F.col("_widest") / F.greatest(spacing(F.col("path")), F.lit(TINY))).cast("int"))
    marked = marked.withColumns({"_window": window, "_excess": F.col("_right") - F.col("_left") - F.col("_widest"), "_sine": F.sin(F.radians(spread / 2))})
    observed = median(_part(F.col("widths"), F.lit(0), 2 * F.col("_window")))
    scale = F.when((F.col("_excess") > 0) & (F.size("path") >= 2 * F.col("_window")), F.least(
        F.lit(1.0), F.greatest(F.lit(0.0), (observed - F.col("_widest")) / F.col("_excess")))).otherwise(1.0)
    travelled = path_length(F.col("path")) + F.col("_trav")
    beyond = F.coalesce(F.col("_proof"), F.lit(False)) & F.coalesce(travelled > F.col("_all") / F.when(F.col("_sine") > 0, F.col("_sine")), F.lit(False))
    many = F.col("_n") > 1
    per_segment = marked.where("_n = 1 or _known = _n").select(
        *at, F.when(~many, interior_width(F.col("widths"))).alias("_alone"), ((F.col("_left") + F.col("_right")) / 2).alias("_middle"), scale.alias("_scale"),
        many.alias("bundle"), (many & (beyond | F.col("_par"))).alias("parallel"), F.when(many, travelled).otherwise(0.0).alias("travelled"))
    return shared.join(per_segment.hint("merge"), at).select(
        *at, "owner", F.coalesce("_alone", "width").alias("width"),
        F.when(F.col("bundle"), (F.col("center") - F.col("_middle")) * F.col("_scale")).otherwise(0.0).alias("offset"), "bundle", "parallel", "travelled")
