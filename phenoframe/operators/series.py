"""Series roll-ups, summaries, ordering, sampling and identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from phenoframe.functions import text as ft
from phenoframe.operators.ordered import ordered_columns


def number_frames(df: DataFrame, group: Sequence[str], date: str, tie: Sequence[str] = ("path",), **kw) -> DataFrame:
    """1-based position of every image in its dated series."""
    return ordered_columns(df, group, [date, *tie], number="frame_no", **kw)


def reconcile_scans(images: DataFrame, expected: str, read: str, attempted: str | None = None) -> DataFrame:
    """Compare read codes with the expected ones, ignoring case. A failed read is not a mismatch."""
    tried = F.col(attempted) if attempted else F.lit(True)
    found = F.coalesce(F.col(read) != "", F.lit(False))
    return images.select(
        "*",
        (tried & found & (F.lower(read) != F.lower(expected))).alias("mismatch"),
        (tried & ~found).alias("not_found"),
        tried.alias("was_attempted"),
    )


def scan_quality(scans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scans.groupBy(*by).agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if(F.col("was_attempted") & ~F.col("not_found")).alias("read"),
        F.count_if("not_found").alias("unread"),
        F.count_if("mismatch").alias("mismatched"),
    )


def rollup(images: DataFrame, group: Sequence[str], date: str, path: str) -> DataFrame:
    """Per series: frame count, date range, scan flags and whether all images are set aside."""
    return images.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_images"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.bool_or("mismatch").alias("has_mismatch"),
        F.count_if("mismatch").alias("n_mismatch"),
        F.bool_or("not_found").alias("has_missing"),
        F.bool_and(ft.is_set_aside(F.col(path))).alias("set_aside"),
    )


def summary_total(stats: DataFrame, image: str, plant: str, date: str) -> DataFrame:
    return stats.agg(
        F.count_distinct(image).alias("total_images"),
        F.count_distinct(plant).alias("total_plants"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    )


def summary_per_plant(
    stats: DataFrame, keys: Sequence[str], order: Sequence[str], length: str, depth: str, rate: str
) -> DataFrame:
    """Latest length and depth and the mean rate of every plant."""
    latest = F.struct(*order)
    return stats.groupBy(*keys).agg(
        F.max_by(length, latest).alias("final_total_length"),
        F.max_by(depth, latest).alias("final_main_root_depth"),
        F.avg(rate).alias("avg_rgr"),
    )


def even_sample(
    df: DataFrame, count: int, order: Sequence[str], group: Sequence[str] = (), **kw
) -> DataFrame:
    """Evenly spaced rows: index floor(i*n/count) for i < count, or all rows when n <= count.

    Only the group and order columns are numbered; the picks are joined back by key.
    """
    keys = [*group, *order]
    grouped = list(group) or ["_all"]
    slim = df.select(*keys)
    if not group:
        slim = slim.withColumn("_all", F.lit(0))
    numbered = ordered_columns(slim, grouped, order, number="_n", **kw)
    sizes = slim.groupBy(*grouped).agg(F.count(F.lit(1)).alias("_size"))
    index = F.col("_n") - 1
    # Row j is picked when some i < count has floor(i*size/count) = j, that is i = ceil(j*count/size).
    pick = F.ceil(index * count / F.col("_size"))
    chosen = (F.col("_size") <= count) | (
        (pick < count) & (F.floor(pick * F.col("_size") / F.lit(float(count))) == index)
    )
    picks = numbered.join(sizes, grouped).where(chosen).select(*keys)
    return df.join(picks, keys, "left_semi")


def series_identity(images: DataFrame, group: str, date: str, path: str) -> DataFrame:
    """Order-free fingerprint of a series' image list.

    The count and two independent 64-bit folds of the rows stay fixed-size however long the
    list is. Frame dates are part of every row, so order is covered by content.
    """
    row = F.struct(F.col(path), F.date_format(F.col(date), "yyyy-MM-dd HH:mm:ss"))
    return images.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_images"),
        F.bit_xor(F.xxhash64(row)).alias("xor_hash"),
        F.sum(F.hash(row).cast("long")).alias("sum_hash"),
    )


def reusable(stored: DataFrame, images: DataFrame, group: str, date: str, path: str) -> DataFrame:
    """Stored rows whose series still has exactly the same images."""
    now = series_identity(images, group, date, path)
    return stored.join(now, [group, "n_images", "xor_hash", "sum_hash"], "left_semi")


def digest_rows(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Content digest that does not depend on row order: all 256 bits of each row's hash, in eight words."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    words = [F.conv(F.substring(row, 8 * k + 1, 8), 16, 10).cast("long") for k in range(8)]
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.bit_xor(w).alias(f"digest_xor_{k}") for k, w in enumerate(words)],
        *[F.sum(w).alias(f"digest_sum_{k}") for k, w in enumerate(words)],
    )


def compare_outputs(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that appeared, disappeared or changed between two versions of a table."""
    values = [c for c in before.columns if c not in keys]

    def hashed(df, name):
        row = F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256)
        return df.select(*keys, row.alias(name))

    joined = hashed(before, "_old").join(hashed(after, "_new"), list(keys), "full_outer")
    change = (
        F.when(F.col("_old").isNull(), F.lit("added"))
        .when(F.col("_new").isNull(), F.lit("removed"))
        .otherwise(F.lit("changed"))
    )
    return joined.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(*keys, change.alias("change"))


def scan_regressions(baseline: DataFrame, current: DataFrame, path: str, code: str) -> DataFrame:
    """Reads that were lost or changed against a baseline run."""
    old = baseline.select(path, F.col(code).alias("old_code"))
    new = current.select(path, F.col(code).alias("new_code"))
    had = F.coalesce(F.col("old_code") != "", F.lit(False))
    has = F.coalesce(F.col("new_code") != "", F.lit(False))
    kind = F.when(had & ~has, "lost").when(had & has & (F.col("old_code") != F.col("new_code")), "changed")
    return (
        old.join(new, path, "full_outer").withColumn("regression", kind)
        .where("regression is not null")
    )


def image_status(
    set_aside: Column, edited: Column, overridden: Column, running: Column, has_result: Column, current: Column
) -> Column:
    """Status word of one image for one stage; earlier reasons win."""
    return (
        F.when(set_aside, "excluded")
        .when(edited, "edited")
        .when(overridden, "override")
        .when(running, "running")
        .when(has_result & current, "done")
        .when(has_result, "outdated")
        .otherwise("pending")
    )


def group_status(images: DataFrame, group: Sequence[str], status: str) -> DataFrame:
    """done-of-total and one status word per group; set-aside images do not count."""
    word = F.col(status)
    grouped = images.groupBy(*group).agg(
        F.count_if(word != "excluded").alias("total"),
        F.count_if(word.isin("done", "override", "edited")).alias("done"),
        F.count_if(word == "running").alias("_running"),
        F.count_if(word == "outdated").alias("_outdated"),
    )
    summary = (
        F.when(F.col("total") == 0, "excluded")
        .when(F.col("done") == F.col("total"), "done")
        .when(F.col("_running") > 0, "running")
        .when(F.col("_outdated") > 0, "outdated")
        .otherwise("pending")
    )
    return grouped.withColumn("status", summary).drop("_running", "_outdated")
