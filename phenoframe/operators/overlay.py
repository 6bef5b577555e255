"""Settings overlays, authoritative overrides, staleness and state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from phenoframe.functions import growth as fg


def with_overrides(base: DataFrame, overrides: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Every override column that is not null replaces the base value."""
    renamed = overrides.select(*key, *[F.col(c).alias(f"_o_{c}") for c in columns])
    joined = base.join(renamed, list(key), "left")
    return joined.select(
        *[F.coalesce(f"_o_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns]
    )


def fingerprint(*columns: Column) -> Column:
    """MD5 of settings; numbers are compared as doubles, so 180 and 180.0 agree."""
    named = [c.alias(f"c{i:02d}") for i, c in enumerate(columns)]
    return F.md5(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}))


def stale_groups(settings: DataFrame, state: DataFrame, group: str, stage_hash: str) -> DataFrame:
    """Groups without a finished stage row under their current settings hash."""
    done = state.where("done").select(group, stage_hash)
    return settings.join(done, [group, stage_hash], "left_anti")


def invalidate(state: DataFrame, group: str, changed: DataFrame, stages: Sequence[str], step: str) -> DataFrame:
    """Mark ``step`` and all later stages of the changed groups as not done."""
    later = list(stages)[list(stages).index(step):]
    marks = changed.select(group).distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & F.col("stage").isin(later)
    return state.join(marks, group, "left").select(
        *[
            F.when(hit, F.lit(False)).otherwise(F.col(c)).alias(c) if c == "done"
            else F.when(~hit, F.col(c)).alias(c) if c == "config_hash"
            else F.col(c)
            for c in state.columns
        ]
    )


def copy_to_all(
    settings: DataFrame, state: DataFrame, group: str, values: dict[str, Column], hashes: Callable[[DataFrame], DataFrame], stages: dict[str, str | None],
) -> tuple[DataFrame, DataFrame]:
    """(settings, state) after ``values`` are written into the settings of every group.

    ``hashes`` adds the hash columns; ``stages`` names, in order, each stage and the hash column it depends on (null: none
    of its own). A group's stage and all later ones are marked as not done only if that hash changed.
    """
    copied = settings.withColumns(values)
    names = [h for h in stages.values() if h]
    before = hashes(settings).select(group, *[F.col(h).alias(f"_{h}") for h in names])
    both = hashes(copied).join(before, group)
    for stage, name in stages.items():
        if name:
            state = invalidate(state, group, both.where(~F.col(name).eqNullSafe(F.col(f"_{name}"))), list(stages), stage)
    return copied, state


def latest_versions(overrides: DataFrame, image: str, version: str) -> DataFrame:
    """Newest override per image; a newest version that is a tombstone removes the override."""
    payload = [c for c in overrides.columns if c != image]
    newest = overrides.groupBy(image).agg(F.max_by(F.struct(*payload), F.col(version)).alias("_v"))
    return newest.select(image, *[F.col(f"_v.{c}").alias(c) for c in payload]).where("not deleted")


def undo_manual(overrides: DataFrame, image: str, version: str, next_version: Column) -> DataFrame:
    """Rows to append that undo the newest manual correction of each image.

    The image falls back to its newest import, or to tracked rows when it never had one.
    """
    newest = overrides.groupBy(image).agg(
        F.max_by(F.struct("manual", "deleted"), F.col(version)).alias("_now"),
        F.max_by(F.struct("source", "deleted"), F.when(~F.col("manual"), F.col(version))).alias("_import"),
    )
    back = F.coalesce(~F.col("_import.deleted"), F.lit(False))
    return newest.where("_now.manual and not _now.deleted").select(
        image,
        F.when(back, F.col("_import.source")).alias("source"),
        F.lit(False).alias("manual"),
        (~back).alias("deleted"),
        next_version.alias(version),
    )


def override_gate(axes: DataFrame, images: DataFrame, image: str) -> DataFrame:
    """Reason why an override does not fit its image, or null; one row per image.

    ``axes`` holds array<array<double>> points per axis; ``n_plants`` comes with the images.
    """
    outside = F.exists(
        "points",
        lambda p: ~(F.coalesce((p[0] >= 0) & (p[0] < F.col("width")) & (p[1] >= 0) & (p[1] < F.col("height")), F.lit(False))),
    )
    checked = axes.join(images.select(image, "width", "height"), image).groupBy(image).agg(
        F.bool_or(F.coalesce(F.size("points"), F.lit(0)) <= 0).alias("_empty"),
        F.bool_or(F.exists("points", lambda p: F.size(p) != 2)).alias("_flat"),
        F.bool_or(outside).alias("_outside"),
    )
    reason = (
        F.when(F.col("n_plants") < 1, "no plant")
        .when(F.col("_empty"), "axis without points")
        .when(F.col("_flat"), "not two-dimensional")
        .when(F.col("_outside"), "outside the image")
    )
    return images.join(checked, image, "left").select(image, reason.alias("reason"))


def replace_frames(tracked: DataFrame, override_rows: DataFrame, image: str) -> DataFrame:
    """Override rows replace all tracked rows of their image."""
    kept = tracked.join(override_rows.select(image).distinct(), image, "left_anti")
    return kept.withColumn("root_source", F.lit("tracked")).unionByName(
        override_rows.withColumn("root_source", F.lit("override")), allowMissingColumns=True
    )


def previous_by_slot(stats: DataFrame, group: str, frame: str, plant: str, columns: Sequence[str]) -> DataFrame:
    """Join the same plant slot of the preceding frame; an absent slot stays null."""
    before = stats.select(
        group, (F.col(frame) + 1).alias(frame), plant, *[F.col(c).alias(f"prev_{c}") for c in columns]
    )
    return stats.join(before, [group, frame, plant], "left")


def previous_by_source(stats: DataFrame, group: str, frame: str, source: str, columns: Sequence[str]) -> DataFrame:
    """Join by source id, only where the id is unique in both frames."""
    unique = (
        stats.where(F.col(source).isNotNull() & (F.col(source) != ""))
        .groupBy(group, frame, source)
        .agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(f"prev_{c}") for c in columns])
        .where("_n = 1").drop("_n")
    )
    here = unique.select(group, frame, source)
    before = unique.withColumn(frame, F.col(frame) + 1)
    matched = here.join(before, [group, frame, source])
    return stats.join(matched, [group, frame, source], "left")


def refresh_rates(
    stats: DataFrame, group: str, frame: str, date: str, plant: str, source: str, lengths: Sequence[str]
) -> DataFrame:
    """Recompute rates of override frames and of their successors.

    Needs ``is_override`` and ``numeric_slots`` per row. Slots are compared when both frames use
    1..n ids, otherwise two override frames are compared by unique source id. Rows whose own and
    preceding frame are both tracked keep their ``*_RGR`` values; pixel-based growth of all
    other rows becomes null.
    """
    frames = stats.groupBy(group, frame).agg(
        F.first(date).alias("_d"), F.bool_or("is_override").alias("_o"), F.bool_and("numeric_slots").alias("_n")
    ).withColumn(frame, F.col(frame) + 1)
    carried = [date, *lengths]
    slot = previous_by_slot(stats, group, frame, plant, carried)
    by_id = previous_by_source(stats, group, frame, source, lengths).select(
        group, frame, plant, *[F.col(f"prev_{c}").alias(f"_id_{c}") for c in lengths]
    )
    rows = slot.join(by_id, [group, frame, plant], "left").join(frames, [group, frame], "left")
    prev_override = F.coalesce(F.col("_o"), F.lit(False))
    touched = F.col("is_override") | prev_override
    same_slots = F.col("numeric_slots") & F.coalesce(F.col("_n"), F.lit(True))
    by_source = F.col("is_override") & prev_override
    days = fg.whole_days(F.col("_d"), F.col(date))
    pixel = ("image_new_area", "image_new_parts", "image_area_change")
    out = []
    for c in stats.columns:
        measure = c.removesuffix("_RGR")
        if c.endswith("_RGR") and measure in lengths:
            prev = F.when(same_slots, F.col(f"prev_{measure}")).when(by_source, F.col(f"_id_{measure}"))
            fresh = fg.relative_rate(F.col(measure), prev, days)
            out.append(F.when(touched, fresh).otherwise(F.col(c)).alias(c))
        elif c in pixel:
            out.append(F.when(~touched, F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return rows.select(*out)
