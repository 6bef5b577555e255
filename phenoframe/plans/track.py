"""Tracking and measuring all series, one frame number at a time.

The frame number is the only sequential axis: ownership needs the pixels owned one frame
earlier. Each step decides that frame of every series together and is written out, which gives
the next step its history and a restart point.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from phenoframe.functions import growth as fg
from phenoframe.operators import components, evidence, linking, mainaxis, measure, pixels, skeleton, spatial, static
from phenoframe.runtime import cut

KEYS = ["group_id"]


@dataclass
class TrackOptions:
    width: int
    height: int
    spacing: float
    low: float = 20
    high: float = 30
    min_pixels: int = 8
    min_area: int = 100
    filter_static: bool = True


def foreground(levels: DataFrame, options: TrackOptions) -> DataFrame:
    """Two-level foreground of all frames: (group_id, frame, x, y)."""
    keys = [*KEYS, "frame"]
    kept = components.two_level(levels, keys, "v", options.low, options.high, min_pixels=options.min_pixels)
    return kept.select(*keys, "x", "y")


def _small_filter(fg: DataFrame, history: DataFrame | None, options: TrackOptions) -> DataFrame:
    labelled = cut(components.label_pixels(fg, KEYS), "labels")
    rescued = None
    if history is not None:
        known = history.groupBy(*KEYS, "owner").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 5").select(*KEYS, "owner")
        prior = history.join(known, [*KEYS, "owner"], "left_semi")
        near = spatial.pairs_within(labelled, prior, 4, KEYS, ["owner"]).join(labelled, [*KEYS, "x", "y"])
        rescued = components.rescued_by_history(near, labelled, KEYS)
    return components.drop_small(labelled, KEYS, options.min_area, rescued)


def track_frame(
    fg: DataFrame, stems: DataFrame, history: DataFrame | None, main_history: DataFrame | None, options: TrackOptions
) -> dict[str, DataFrame]:
    """Tables of one frame for all series: totals, owned, main, links and measures."""
    kept = cut(_small_filter(fg, history, options), "kept")
    area = kept.select(*KEYS, "x", "y")
    lines = skeleton.thin(area, KEYS)
    totals = measure.image_totals(area, lines, KEYS)
    rooted = pixels.clear_above_stems(lines, stems, KEYS, F.lit(options.width))
    segments, points = linking.frame_segments(rooted, kept, KEYS, options.width, options.height, options.min_pixels)
    extent = max(options.width, options.height)
    none = points.select(*KEYS, "seg", F.lit(None).cast("int").alias("owner")).where("false")
    forced = linking.forced_owners(points, history, KEYS) if history is not None else none
    base = cut(
        linking.link_rounds(segments, stems, forced, kept, KEYS, options.spacing, extent, options.filter_static), "base"
    )
    if history is not None:
        support = evidence.coverage_vote(points, history, KEYS, "seg", "owner").select(
            *KEYS, "seg", F.col("owner").cast("int").alias("support_owner"), "share"
        )
    else:
        support = none.select(*KEYS, "seg", F.lit(None).cast("int").alias("support_owner"), F.lit(None).cast("double").alias("share"))
    flows = cut(linking.route(segments, base, stems, support, KEYS, points), "routed")
    held = flows.groupBy(*KEYS, "owner", "seg").agg(F.max(F.coalesce("until", F.lit(2**31 - 1))).alias("_until"))
    owned = cut(held.join(points, [*KEYS, "seg"]).where("pos < _until").drop("_until"), "owned")
    main = cut(mainaxis.main_axis(flows, segments, points, main_history, KEYS, history), "main")
    links = flows.join(segments.select(*KEYS, "seg", "upper_x", "upper_y"), [*KEYS, "seg"]).select(
        *KEYS, "seg", "owner", F.col("upper_x").alias("child_x"), F.col("upper_y").alias("child_y"), "parent_x", "parent_y"
    )
    ends = flows.select(*KEYS, "owner", "seg").distinct().join(segments.select(*KEYS, "seg", "lower_x", "lower_y"), [*KEYS, "seg"])
    counts = measure.root_counts(ends, links, KEYS, "owner")
    lengths = measure.owned_lengths(owned, main, KEYS, "owner")
    measures = (
        stems.select(*KEYS, "owner", F.col("x").alias("plant_center_x"), F.col("y").alias("plant_center_y"))
        .join(lengths, [*KEYS, "owner"], "left").join(counts, [*KEYS, "owner"], "left").join(totals, KEYS, "left")
        .na.fill(0, ["plant_total_length", "plant_main_root_length", "plant_main_root_depth", "root_count", "tip_count"])
    )
    return {"owned": owned, "main": main, "links": links, "measures": measures}


def track(
    levels: DataFrame, stems: DataFrame, options: TrackOptions, target: str, mask: DataFrame | None = None
) -> DataFrame:
    """Track all series and return one measure row per (group_id, frame, owner).

    levels  (group_id, frame, x, y, v): background-free levels, frames numbered from 0
    stems   (group_id, owner, x, y): shared origins, owners numbered from 0
    target  shared folder; every frame is written to ``<target>/<table>/frame=<n>``
    mask    (group_id, x, y): excluded pixels
    """
    spark = levels.sparkSession
    keys = [*KEYS, "frame"]
    fg = cut(foreground(levels, options), "foreground")
    if options.filter_static:
        frames = levels.select(*keys).distinct().withColumn("usable", F.lit(True))
        fg = cut(static.drop_static(fg, stems, frames, KEYS, "frame", max(options.width, options.height)), "moving")
    if mask is not None:
        fg = fg.join(mask.select(*KEYS, "x", "y"), [*KEYS, "x", "y"], "left_anti")
    last = levels.agg(F.max("frame")).first()[0]
    history = main_history = None
    for number in range(0 if last is None else last + 1):
        here = fg.where(F.col("frame") == number).drop("frame")
        active = levels.where(F.col("frame") == number).select(*KEYS).distinct()
        tables = track_frame(here, stems.join(active, KEYS, "left_semi"), history, main_history, options)
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{target}/{name}/frame={number}")
        history = spark.read.parquet(f"{target}/owned/frame={number}").select(*KEYS, "owner", "x", "y").distinct()
        main = spark.read.parquet(f"{target}/main/frame={number}")
        grown = main.join(linking.has_axis(main, [*KEYS, "owner"]), [*KEYS, "owner"], "left_semi").select(*KEYS, "owner", "x", "y")
        if main_history is not None:
            # An owner with a main axis keeps adding to it, however short the new observation.
            known = main_history.select(*KEYS, "owner").distinct()
            grown = main_history.unionByName(grown).unionByName(
                main.join(known, [*KEYS, "owner"], "left_semi").select(*KEYS, "owner", "x", "y")
            ).distinct()
        main_history = cut(grown, "main_history")
    return spark.read.parquet(f"{target}/measures")


def statistics(measures: DataFrame, images: DataFrame, growth: DataFrame) -> DataFrame:
    """Result rows with rates and area change.

    images (group_id, frame, date, path, code_read, expected_code); growth (group_id, frame,
    new_area, new_parts). The preceding frame is joined by its number, so an absent frame
    gives null rates.
    """
    keys = [*KEYS, "frame"]
    rows = measures.join(images, keys).join(growth, keys, "left")
    before = rows.select(
        *KEYS, (F.col("frame") + 1).alias("frame"), "owner", F.col("date").alias("_date"), F.col("plant_total_length").alias("_length"),
        F.col("plant_main_root_length").alias("_main"), F.col("image_total_area").alias("_area"),
    )
    joined = rows.join(before, [*keys, "owner"], "left")
    days = fg.whole_days(F.col("_date"), F.col("date"))
    return joined.select(
        "group_id", "frame", F.col("date").alias("image_date"), F.col("expected_code").alias("image_barcode"),
        F.col("code_read").alias("image_barcode_read"), F.col("path").alias("image_path"), "image_total_area", "image_total_length",
        F.col("new_area").alias("image_new_area"), F.col("new_parts").alias("image_new_parts"),
        fg.area_change(F.col("image_total_area"), F.col("new_area"), F.col("_area")).alias("image_area_change"),
        (F.col("owner") + 1).alias("plant_id"), "plant_center_x", "plant_center_y",
        F.col("root_count").alias("plant_root_count"), "plant_total_length",
        fg.relative_rate(F.col("plant_total_length"), F.col("_length"), days).alias("plant_total_length_RGR"),
        "plant_main_root_depth", "plant_main_root_length",
        fg.relative_rate(F.col("plant_main_root_length"), F.col("_main"), days).alias("plant_main_root_length_RGR"),
    )
