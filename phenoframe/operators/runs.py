"""Runs, fragments and rolling medians along ordered paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from phenoframe.operators.ordered import ordered_columns, runs
from phenoframe.runtime import cut

CHUNK = 4096
TILE = 8  # pixels along a side; a tile of mask is one number of 64 bits


def sustained_runs(
    flagged: DataFrame, path: Sequence[str], index: str, *, max_step: int = 3, min_rows: int = 5, **kw
) -> DataFrame:
    """Runs of flagged positions whose steps are at most ``max_step`` and that have enough rows."""
    lagged = ordered_columns(flagged, path, [index], lags={"_prev": F.col(index)}, **kw)
    broken = F.when(F.col("_prev").isNull() | (F.col(index) - F.col("_prev") > max_step), 1).otherwise(0)
    numbered = ordered_columns(lagged.withColumn("_cut", broken), path, [index], sums={"run": F.col("_cut")}, **kw)
    return (
        numbered.groupBy(*path, "run")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min(index).alias("first_pos"), F.max(index).alias("last_pos"))
        .where(F.col("n_rows") >= min_rows)
    )


def first_sustained(flagged: DataFrame, path: Sequence[str], index: str, length: int, **kw) -> DataFrame:
    """First position from which ``length`` consecutive positions are flagged."""
    found = sustained_runs(flagged, path, index, max_step=1, min_rows=length, **kw)
    return found.groupBy(*path).agg(F.min("first_pos").alias("position"))


def fragments(df: DataFrame, path: Sequence[str], index: str, label: Column, *, into: str = "fragment", **kw) -> DataFrame:
    """Stretches of equal label with their first and last position."""
    numbered = runs(df.withColumn("_label", label), path, [index], F.col("_label"), into=into, **kw)
    return numbered.groupBy(*path, into).agg(
        F.first("_label").alias("label"), F.min(index).alias("first_pos"), F.max(index).alias("last_pos"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def rolling_median(df: DataFrame, path: Sequence[str], index: str, value: str, radius: int, *, into: str = "median") -> DataFrame:
    """Median over 2*radius+1 positions; beyond the ends the end value repeats.

    ``index`` is dense from 0. A path is cut into chunks that also receive ``radius`` rows of
    their neighbours, so one very long path is spread over many tasks.
    """
    ends = df.groupBy(*path).agg(F.max(index).alias("_end"))
    rows = df.select(*path, index, value).join(ends, list(path))
    # Extra copies of the end rows stand for the positions beyond the ends.
    copies = F.array_union(
        F.when(F.col(index) == 0, F.sequence(F.lit(-radius), F.lit(0))).otherwise(F.array(F.col(index).cast("int"))),
        F.when(F.col(index) == F.col("_end"), F.sequence(F.col("_end").cast("int"), F.col("_end").cast("int") + radius))
        .otherwise(F.array(F.col(index).cast("int"))),
    )
    padded = rows.select(*path, F.explode(copies).alias("_pos"), value, "_end")
    chunks = F.array_distinct(
        F.array(
            F.floor(F.col("_pos") / CHUNK), F.floor((F.col("_pos") - radius) / CHUNK), F.floor((F.col("_pos") + radius) / CHUNK)
        )
    )
    spread = padded.withColumn("_chunk", F.explode(chunks))
    window = Window.partitionBy(*path, "_chunk").orderBy("_pos").rowsBetween(-radius, radius)
    smooth = spread.withColumn(into, F.percentile(value, F.lit(0.5)).over(window))
    inside = (F.col("_pos") >= 0) & (F.col("_pos") <= F.col("_end")) & (F.floor(F.col("_pos") / CHUNK) == F.col("_chunk"))
    return smooth.where(inside).select(*path, F.col("_pos").alias(index), into)


def nearest_label(df: DataFrame, path: Sequence[str], arc: str, label: str, **kw) -> DataFrame:
    """Label of the closest labelled position by arc length; the earlier one wins ties."""
    here = F.when(F.col(label).isNotNull(), F.struct(F.col(arc).alias("at"), F.col(label).alias("label")))
    rows = df.withColumn("_here", here).withColumn("_back", -F.col(arc))
    rows = ordered_columns(rows, path, [arc], known={"_before": F.col("_here")}, **kw)
    rows = ordered_columns(rows, path, ["_back"], known={"_after": F.col("_here")}, **kw)
    left, right = F.coalesce("_here", "_before"), F.coalesce("_here", "_after")
    rows = rows.withColumn("_left", left).withColumn("_right", right)
    closer = F.col("_left").isNotNull() & (
        F.col("_right").isNull() | (F.col(arc) - F.col("_left.at") <= F.col("_right.at") - F.col(arc))
    )
    chosen = F.when(closer, F.col("_left.label")).otherwise(F.col("_right.label"))
    return rows.select(*df.columns, chosen.alias("nearest_label"))


def next_point(points: DataFrame, path: Sequence[str], index: str, x: str, y: str) -> DataFrame:
    """Each point with its successor, by an equi-join on the dense index."""
    after = points.select(*path, (F.col(index) - 1).alias(index), F.col(x).alias("_nx"), F.col(y).alias("_ny"))
    return points.join(after, [*path, index], "left")


def path_length(points: DataFrame, path: Sequence[str], index: str, x: str, y: str) -> DataFrame:
    """Length, depth and point count of polylines given as rows."""
    step = F.coalesce(F.hypot(F.col("_nx") - F.col(x), F.col("_ny") - F.col(y)), F.lit(0.0))
    return next_point(points, path, index, x, y).groupBy(*path).agg(
        F.sum(step).alias("length"), (F.max(y) - F.min(y)).alias("depth"), F.count(F.lit(1)).alias("n_points")
    )


def _spans(points: DataFrame, path: Sequence[str], index: str, x: str, y: str) -> DataFrame:
    """Each point with its successor and the number of samples (``_count``) from it on, before the next."""
    count = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("_nx") - F.col(x)), F.abs(F.col("_ny") - F.col(y)))).cast("int"))
    # The end point of a piece belongs to the next piece; the last point stands alone.
    return next_point(points, path, index, x, y).withColumn("_count", F.when(F.col("_nx").isNull(), 1).otherwise(count))


def _sample(at: str, after: str, step: Column) -> Column:
    return F.col(at) + F.coalesce((F.col(after) - F.col(at)) * (step / F.col("_count")), F.lit(0.0))


def densify(points: DataFrame, path: Sequence[str], index: str, x: str = "x", y: str = "y") -> DataFrame:
    """Samples along each polyline at most one pixel apart: (path, index, step, x, y)."""
    sampled = _spans(points, path, index, x, y).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    step = F.col("step")
    return sampled.select(*path, index, "step", _sample(x, "_nx", step).alias("x"), _sample(y, "_ny", step).alias("y"))


def _hidden_steps(spans: DataFrame, mask: DataFrame, path: Sequence[str], index: str, group: Sequence[str]) -> DataFrame:
    """(path, index, _hidden): the samples of each span that lie on the mask, ascending; spans without any have no row.

    Mask and spans meet in tiles, so samples are made where a tile holds mask and never moved.
    """
    def tile(x, y):
        return F.shiftleft(F.shiftright(x, 3).cast("long"), 32).bitwiseOR(F.shiftright(y, 3).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))

    def bit(x, y):
        return x.bitwiseAND(F.lit(7)) * 8 + y.bitwiseAND(F.lit(7))

    def pixel(step):
        return [F.rint(_sample(at, after, step)).cast("int") for at, after in (("x", "_nx"), ("y", "_ny"))]

    here = [F.col(c).cast("int") for c in ("x", "y")]
    marks = mask.select(*group, tile(*here).alias("_tile"), bit(*here).alias("_bit")).groupBy(*group, "_tile").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))).alias("_bits"))
    last, first, step = F.col("_count") - 1, F.col("_first"), F.col("step")
    enters = spans.withColumn("_first", F.explode(F.sequence(F.lit(0), last))).withColumn("_tile", tile(*pixel(first))).where(
        (first == 0) | ~tile(*pixel(first - 1)).eqNullSafe(F.col("_tile")))
    # Samples are more than half a pixel apart, so at most 17 in a row lie in a tile. Spark takes the rows of both sides for few.
    steps = enters.hint("merge").join(marks, [*group, "_tile"]).withColumn("step", F.explode(F.sequence(first, F.least(first + 2 * TILE, last))))
    on = F.call_function("shiftright", F.col("_bits"), bit(*pixel(step))).bitwiseAND(F.lit(1)) == 1
    return steps.where((tile(*pixel(step)) == F.col("_tile")) & on).groupBy(*path, index).agg(F.sort_array(F.collect_list("step")).alias("_hidden"))


def visible_runs(
    points: DataFrame, mask: DataFrame, path: Sequence[str], index: str, group: Sequence[str], **kw
) -> DataFrame:
    """Pieces of each polyline outside the mask: (path, piece, index, step, x, y).

    A polyline that never meets the mask keeps its own vertices; others are densified. Pieces are numbered from the
    vertices, each with the runs of visible samples up to the next; the samples are made last.
    """
    spans = cut(_spans(points.select(*path, index, "x", "y"), path, index, "x", "y"), "spans")
    hidden = cut(_hidden_steps(spans, mask, path, index, group), "hidden")
    touched = hidden.select(*path).distinct()
    whole = spans.join(touched, list(path), "left_anti").select(
        *path, F.lit(1).cast("long").alias("piece"), index, F.lit(0).alias("step"),
        F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"),
    )
    none = F.array().cast("array<int>")
    rows = spans.join(touched, list(path), "left_semi").join(hidden, [*path, index], "left").withColumn("_hidden", F.coalesce("_hidden", none))
    between = F.zip_with(
        F.concat(F.array(F.lit(-1)), F.col("_hidden")), F.concat(F.col("_hidden"), F.array(F.col("_count"))),
        lambda a, b: F.struct((a + 1).alias("first"), (b - 1).alias("last")))
    rows = rows.withColumn("_runs", F.filter(between, lambda r: r["first"] <= r["last"])).drop("_hidden")
    ends_hidden = F.coalesce(F.try_element_at("_runs", F.lit(-1))["last"] < F.col("_count") - 1, F.lit(True))
    rows = ordered_columns(rows, path, [index], lags={"_was": ends_hidden}, **kw)
    goes_on = F.coalesce((F.get("_runs", F.lit(0))["first"] == 0) & ~F.col("_was"), F.lit(False))
    rows = ordered_columns(rows.withColumn("_starts", F.size("_runs") - goes_on.cast("int")), path, [index], sums={"_upto": F.col("_starts")}, **kw)
    pieces = rows.select("*", F.posexplode("_runs").alias("_at", "_run")).withColumn(
        "piece", (F.col("_upto") - F.size("_runs") + 1 + F.col("_at")).cast("long")).withColumn("step", F.explode(F.sequence("_run.first", "_run.last")))
    step = F.col("step")
    return whole.unionByName(pieces.select(*path, "piece", index, "step", _sample("x", "_nx", step).alias("x"), _sample("y", "_ny", step).alias("y")))
