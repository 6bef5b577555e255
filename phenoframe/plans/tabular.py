"""Bindings of the series, growth, scan, drift and settings operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenoframe.functions import camera, text as ft
from phenoframe.operators import drift, growth, ordered, overlay, series
from phenoframe.plans.registry import query, table
from phenoframe.sources import images as si

DAILY = """daily AS (
  SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v, count(*) AS n,
         max(value) AS peak
  FROM events GROUP BY 1, 2)"""


def daily(spark, folder):
    """One row per user and day: at most one row per calendar day, so windows stay small."""
    return (
        table(spark, folder, "events")
        .groupBy("user_id", F.date_trunc("day", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz").alias("day"))
        .agg(
            F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("v"),
            F.count(F.lit(1)).alias("n"),
            F.max("value").alias("peak"),
        )
    )


def day_text(column="day"):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


@query("growth_rate", f"""WITH {DAILY}, lagged AS (
  SELECT *, lag(day) OVER w AS pd, lag(v) OVER w AS pv, lag(n) OVER w AS pn
  FROM daily WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, v, n, date_sub('day', pd, day) AS elapsed_days,
  round(CASE WHEN v > 0 AND pv > 0 AND date_sub('day', pd, day) > 0 THEN (ln(v) - ln(pv)) / date_sub('day', pd, day) END, 6) AS v_rgr,
  round(CASE WHEN n > 0 AND pn > 0 AND date_sub('day', pd, day) > 0 THEN (ln(n) - ln(pn)) / date_sub('day', pd, day) END, 6) AS n_rgr
FROM lagged""")
def growth_rate(spark, folder):
    rates = growth.growth_rates(daily(spark, folder), ["user_id"], "day", {"v": "v_rgr", "n": "n_rgr"}, bounded=True)
    return rates.select("user_id", day_text(), "v", "n", "elapsed_days", F.round("v_rgr", 6).alias("v_rgr"), F.round("n_rgr", 6).alias("n_rgr"))


@query("growth_violations", f"""WITH {DAILY}, long AS (
  SELECT user_id, day, 'v' AS measure, v AS value FROM daily
  UNION ALL SELECT user_id, day, 'n', CAST(n AS DOUBLE) FROM daily
  UNION ALL SELECT user_id, day, 'peak', peak FROM daily),
lagged AS (SELECT *, lag(value) OVER (PARTITION BY user_id, measure ORDER BY day) AS previous FROM long)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, measure, previous, value FROM lagged WHERE value < previous""")
def growth_violations(spark, folder):
    rows = daily(spark, folder)
    found = growth.decreases(rows, ["user_id"], "day", ["v", "n", "peak"], bounded=True)
    return found.select("user_id", day_text(), "measure", "previous", "value")


@query("area_change", f"""WITH {DAILY}
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, v, peak,
  round(CASE WHEN v > 0 AND lag(v) OVER w > 0 THEN abs(v - peak - lag(v) OVER w) / lag(v) OVER w * 100.0 END, 6) AS area_change
FROM daily WINDOW w AS (PARTITION BY user_id ORDER BY day)""")
def area_change(spark, folder):
    rows = growth.area_changes(daily(spark, folder), ["user_id"], "day", "v", "peak", bounded=True)
    return rows.select("user_id", day_text(), "v", "peak", F.round("area_change", 6).alias("area_change"))


@query("number_frames", """SELECT o_custkey, o_orderkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS frame_no FROM orders""")
def number_frames(spark, folder):
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    numbered = series.number_frames(rows, ["o_custkey"], "o_orderdate", ["o_orderkey"])
    return numbered.select("o_custkey", "o_orderkey", "frame_no")


@query("number_frames_hot_group", """SELECT o_orderstatus, o_orderkey,
  row_number() OVER w AS frame_no,
  round(lag(o_totalprice) OVER w, 2) AS previous_price,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_price
FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)""")
def number_frames_hot_group(spark, folder):
    """Three status groups hold all orders: every group is far above the row limit used here."""
    rows = table(spark, folder, "orders").select("o_orderstatus", "o_orderkey", "o_orderdate", "o_totalprice")
    out = ordered.ordered_columns(
        rows, ["o_orderstatus"], ["o_orderdate", "o_orderkey"], number="frame_no",
        lags={"previous_price": F.col("o_totalprice")},
        sums={"running_price": F.col("o_totalprice").cast("decimal(18,2)")},
    )
    return out.select(
        "o_orderstatus", "o_orderkey", "frame_no", F.round("previous_price", 2).alias("previous_price"),
        F.col("running_price").cast("double").alias("running_price"),
    )


@query("series_summary_total", """SELECT count(DISTINCT o_orderkey) AS total_images, count(DISTINCT o_custkey) AS total_plants,
  strftime(min(o_orderdate), '%Y-%m-%d') AS first_date, strftime(max(o_orderdate), '%Y-%m-%d') AS last_date FROM orders""")
def series_summary_total(spark, folder):
    rows = series.summary_total(table(spark, folder, "orders"), "o_orderkey", "o_custkey", "o_orderdate")
    return rows.select("total_images", "total_plants", day_text("first_date"), day_text("last_date"))


@query("series_summary", """SELECT o_custkey, arg_max(o_totalprice, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS final_total_length,
  arg_max(length(o_orderpriority), o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS final_main_root_depth,
  round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS avg_rgr FROM orders GROUP BY 1""")
def series_summary(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", F.length("o_orderpriority").cast("long").alias("depth"),
    )
    out = series.summary_per_plant(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "depth", "o_totalprice")
    return out.withColumn("avg_rgr", F.round("avg_rgr", 6))


def scanned_customers(spark, folder):
    read = (
        F.when(F.col("c_custkey") % 7 == 0, F.upper("c_name"))
        .when(F.col("c_custkey") % 7 == 1, F.concat("c_name", F.lit("X")))
        .when(F.col("c_custkey") % 7 != 2, F.col("c_name"))
    )
    rows = table(spark, folder, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment", F.col("c_name").alias("expected"), read.alias("code_read")
    )
    return series.reconcile_scans(rows, "expected", "code_read")


SCANS = """scans AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_name AS expected,
  CASE WHEN c_custkey % 7 = 0 THEN upper(c_name) WHEN c_custkey % 7 = 1 THEN c_name || 'X'
       WHEN c_custkey % 7 <> 2 THEN c_name END AS code_read FROM customer),
judged AS (SELECT *, code_read IS NOT NULL AND lower(code_read) <> lower(expected) AS mismatch, code_read IS NULL AS not_found FROM scans)"""


@query("reconcile_codes", f"WITH {SCANS} SELECT c_custkey, expected, code_read, mismatch, not_found FROM judged")
def reconcile_codes(spark, folder):
    return scanned_customers(spark, folder).select("c_custkey", "expected", "code_read", "mismatch", "not_found")


@query("scan_quality", f"""WITH {SCANS} SELECT c_mktsegment, count(*) AS images, count(code_read) AS read,
  count(*) FILTER (not_found) AS unread, count(*) FILTER (mismatch) AS mismatched FROM judged GROUP BY 1""")
def scan_quality(spark, folder):
    return series.scan_quality(scanned_customers(spark, folder), ["c_mktsegment"])


@query("scan_regressions", """WITH pairs AS (SELECT c_custkey,
    CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS old_code,
    CASE WHEN c_custkey % 7 = 1 THEN c_name || 'X' WHEN c_custkey % 7 <> 2 THEN c_name END AS new_code FROM customer)
SELECT c_custkey, old_code, new_code, CASE WHEN new_code IS NULL THEN 'lost' ELSE 'changed' END AS regression
FROM pairs WHERE old_code IS NOT NULL AND (new_code IS NULL OR new_code <> old_code)""")
def scan_regressions(spark, folder):
    rows = table(spark, folder, "customer")
    key = F.col("c_custkey")
    old = rows.select("c_custkey", F.when(key % 5 != 0, F.col("c_name")).alias("code"))
    new = rows.select(
        "c_custkey", F.when(key % 7 == 1, F.concat("c_name", F.lit("X"))).when(key % 7 != 2, F.col("c_name")).alias("code")
    )
    return series.scan_regressions(old, new, "c_custkey", "code")


@query("series_rollup", f"""WITH {SCANS} SELECT c_custkey % 50 AS grp, count(*) AS n_images,
  strftime(min(o_orderdate), '%Y-%m-%d') AS first_date, strftime(max(o_orderdate), '%Y-%m-%d') AS last_date,
  bool_or(mismatch) AS has_mismatch, count(*) FILTER (mismatch) AS n_mismatch, bool_or(not_found) AS has_missing,
  bool_and(c_custkey % 11 = 0) AS set_aside
FROM orders JOIN judged ON o_custkey = c_custkey GROUP BY 1""")
def series_rollup(spark, folder):
    scans = scanned_customers(spark, folder).select("c_custkey", "mismatch", "not_found")
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    rows = orders.join(scans, "c_custkey").select(
        (F.col("c_custkey") % 50).alias("grp"), "o_orderdate", "mismatch", "not_found",
        F.when(F.col("c_custkey") % 11 == 0, F.lit("data/aside/x.jpg")).otherwise(F.lit("data/x.jpg")).alias("path"),
    )
    out = series.rollup(rows, ["grp"], "o_orderdate", "path")
    return out.withColumn("first_date", day_text("first_date")).withColumn("last_date", day_text("last_date"))


def dated_paths(spark, folder):
    key = F.col("o_orderkey")
    name = F.concat(
        F.lit("RT_"), F.col("o_custkey").cast("string"), F.lit("."), F.date_format("o_orderdate", "yy-MM-dd"),
        F.when(key % 13 == 0, "_1").otherwise(""),
        F.when(key % 17 == 0, "-bad").otherwise(""), F.lit(".JPG"),
    )
    place = F.when(key % 10 == 0, "photos/aside/").otherwise("photos/")
    return table(spark, folder, "orders").select("o_orderkey", F.concat(place, name).alias("path"))


PATHS = """paths AS (SELECT o_orderkey, o_custkey, o_orderdate,
  CASE WHEN o_orderkey % 10 = 0 THEN 'photos/aside/' ELSE 'photos/' END || 'RT_' || o_custkey || '.' || strftime(o_orderdate, '%y-%m-%d')
  || CASE WHEN o_orderkey % 13 = 0 THEN '_1' ELSE '' END || CASE WHEN o_orderkey % 17 = 0 THEN '-bad' ELSE '' END || '.JPG' AS path FROM orders)"""


@query("parse_dated_name", f"""WITH {PATHS} SELECT o_orderkey, path, 'RT_' || o_custkey AS group_id,
  strftime(o_orderdate, '%Y-%m-%d') AS date, sha256(path) AS image_id, o_orderkey % 10 = 0 AS set_aside,
  regexp_extract(path, '[^/]*$') AS file_name, 'RT_' || o_custkey AS expected_code
FROM paths WHERE o_orderkey % 17 <> 0""")
def parse_dated_name(spark, folder):
    rows = si.dated_series(dated_paths(spark, folder), include_set_aside=True)
    return rows.select("o_orderkey", "path", "group_id", day_text("date"), "image_id", "set_aside", "file_name", "expected_code")


@query("exclude_set_aside", f"""WITH {PATHS} SELECT o_orderkey, path FROM paths WHERE o_orderkey % 17 <> 0 AND o_orderkey % 10 <> 0""")
def exclude_set_aside(spark, folder):
    return si.dated_series(dated_paths(spark, folder)).select("o_orderkey", "path")


@query("rejected_names", f"WITH {PATHS} SELECT o_orderkey, path FROM paths WHERE o_orderkey % 17 = 0")
def rejected_names(spark, folder):
    return si.rejected_names(dated_paths(spark, folder)).select("o_orderkey", "path")


@query("path_columns", r"""SELECT page_id, split_part(url, '/', -1) AS file_name,
  CASE WHEN length(regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g')) = 0 THEN 'series' ELSE substr(regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 60) END AS safe_name,
  substr(regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 60) || '-' || substr(sha256(url), 1, 12) AS export_folder FROM pages""")
def path_columns(spark, folder):
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", ft.file_name(url).alias("file_name"), ft.safe_name(url).alias("safe_name"),
        ft.export_folder(url).alias("export_folder"),
    )


def document_tags(spark, folder):
    docs = table(spark, folder, "documents").select(
        "source", "doc_id",
        F.map_filter(
            F.create_map(
                F.lit("lang"), F.col("lang"),
                F.lit("size"), F.floor(F.log10(F.col("n_chars") + 1)).cast("string"),
                F.lit("parity"), F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 2).cast("string")),
            ),
            lambda k, v: v.isNotNull(),
        ).alias("tags"),
    )
    return docs, drift.tags_to_long(docs, "source", "doc_id", "tags")


TAGS = """tags AS (
  SELECT source, doc_id, 'lang' AS key, lang AS value FROM documents WHERE lang IS NOT NULL
  UNION ALL SELECT source, doc_id, 'size', CAST(CAST(floor(log10(n_chars + 1)) AS BIGINT) AS VARCHAR) FROM documents
  UNION ALL SELECT source, doc_id, 'parity', CAST(doc_id % 2 AS VARCHAR) FROM documents WHERE doc_id % 3 <> 0),
cells AS (SELECT d.source, d.doc_id, k.key, t.value FROM documents d
  JOIN (SELECT DISTINCT source, key FROM tags) k ON d.source = k.source
  LEFT JOIN tags t ON t.source = d.source AND t.doc_id = d.doc_id AND t.key = k.key),
tally AS (SELECT source, key, value, count(*) AS n FROM cells GROUP BY 1, 2, 3),
modes AS (SELECT source, key, max(n) AS top, count(*) AS kinds FROM tally GROUP BY 1, 2),
leaders AS (SELECT t.source, t.key, m.kinds, count(*) AS k, max(t.value) AS v FROM tally t JOIN modes m ON t.source = m.source AND t.key = m.key AND t.n = m.top GROUP BY 1, 2, 3),
flagged AS (SELECT c.source, c.doc_id, c.key, c.value FROM cells c JOIN leaders l ON c.source = l.source AND c.key = l.key
  WHERE l.kinds > 1 AND (l.k > 1 OR c.value IS DISTINCT FROM l.v))"""


@query("settings_drift", f"WITH {TAGS} SELECT source, doc_id, key, value FROM flagged")
def settings_drift(spark, folder):
    docs, tags = document_tags(spark, folder)
    return drift.deviations(tags, docs, "source", "doc_id")


@query("settings_unanimity", f"""WITH {TAGS} SELECT source, key, kinds = 1 AS same, k = 1 AS unique_mode, CASE WHEN k = 1 THEN v END AS mode FROM leaders""")
def settings_unanimity(spark, folder):
    docs, tags = document_tags(spark, folder)
    return drift.key_modes(drift.value_tally(tags, docs, "source", "doc_id"), "source")


@query("value_tally", f"WITH {TAGS} SELECT source, key, value, n FROM tally")
def value_tally(spark, folder):
    docs, tags = document_tags(spark, folder)
    return drift.value_tally(tags, docs, "source", "doc_id")


@query("value_tally_text", f"""WITH {TAGS} SELECT source, key,
  string_agg(coalesce(value, '(missing)') || ' (' || n || ')', '; ' ORDER BY value IS NULL, value) AS tally FROM tally GROUP BY 1, 2""")
def value_tally_text(spark, folder):
    docs, tags = document_tags(spark, folder)
    return drift.tally_text(drift.value_tally(tags, docs, "source", "doc_id"), "source")


@query("image_warnings", f"""WITH {TAGS}, keys AS (SELECT source, doc_id, string_agg(key, ', ' ORDER BY key) AS ks FROM flagged GROUP BY 1, 2)
SELECT d.source, d.doc_id, concat_ws('; ', 'Metadata differs: ' || ks, CASE WHEN d.doc_id % 19 = 0 THEN 'Metadata read warning: truncated' END) AS warning
FROM documents d LEFT JOIN keys k ON k.source = d.source AND k.doc_id = d.doc_id
WHERE d.source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 5) AND (ks IS NOT NULL OR d.doc_id % 19 = 0)""")
def image_warnings(spark, folder):
    docs, tags = document_tags(spark, folder)
    images = docs.select(
        "source", "doc_id",
        F.when(F.col("doc_id") % 19 == 0, "truncated").otherwise("").alias("error"),
        (F.col("doc_id") % 97 != 5).alias("has_tags"),
    )
    return drift.image_warnings(drift.deviations(tags, docs, "source", "doc_id"), images, "source", "doc_id", "error", "has_tags")


@query("preferred_setting", """WITH k AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
shown AS (SELECT event_id, k,
  CASE WHEN k % 3 = 0 THEN 'f/' || (CASE WHEN k % 2 = 0 THEN CAST(k // 2 AS VARCHAR) ELSE CAST(k // 2 AS VARCHAR) || '.5' END) END AS aperture,
  CASE WHEN k % 5 <> 0 THEN CAST(k * 100 AS VARCHAR) END AS iso,
  CASE k % 4 WHEN 1 THEN 'Manual' WHEN 0 THEN 'Auto' END AS wb,
  CASE WHEN k % 2 = 0 THEN 'Fired' ELSE 'Did not fire' END AS flash,
  CASE WHEN k > 0 THEN (CASE WHEN k % 2 = 0 THEN '1/' || CAST(k // 2 AS VARCHAR) ELSE '2/' || CAST(k AS VARCHAR) END) END AS exposure FROM k)
SELECT event_id, 'Aperture' AS setting, aperture AS value FROM shown WHERE aperture IS NOT NULL
UNION ALL SELECT event_id, 'ISO sensitivity', iso FROM shown WHERE iso IS NOT NULL
UNION ALL SELECT event_id, 'White balance', wb FROM shown WHERE wb IS NOT NULL
UNION ALL SELECT event_id, 'Flash', flash FROM shown
UNION ALL SELECT event_id, 'Exposure time', CASE WHEN k = 1 THEN '2 s' WHEN k = 2 THEN '1 s' ELSE exposure || ' s' END FROM shown WHERE k > 0
UNION ALL SELECT event_id, 'Exposure time', '0 s' FROM shown WHERE k = 0""")
def preferred_setting(spark, folder):
    k = F.from_json("props", "k int")["k"]
    rows = table(spark, folder, "events").select("event_id", k.alias("k"))
    half = (F.col("k") / 2.0).cast("string")
    tags = F.map_filter(
        F.create_map(
            F.lit("EXIF:FNumber"), F.when(F.col("k") % 3 == 0, half).otherwise("unknown"),
            F.lit("Sony:ISO"), F.when(F.col("k") % 5 != 0, (F.col("k") * 100).cast("string")).otherwise("undefined"),
            F.lit("File:ISO"), F.lit("7"),
            F.lit("EXIF:WhiteBalance"), (F.col("k") % 4).cast("string"),
            F.lit("IFD0:Flash"), (F.col("k") + 1).cast("string"),
            F.lit("EXIF:ExposureTime"),
            F.when(F.col("k") > 0, F.concat(F.lit("2/"), F.col("k").cast("string"))).otherwise("0"),
            F.lit("NoGroup"), F.lit("1"),
        ),
        lambda key, v: v.isNotNull(),
    )
    return camera.photo_settings(rows.withColumn("tags", tags), ["event_id"], "tags")


@query("derived_settings", """WITH k AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, 'White balance red gain' AS setting, CASE WHEN (k + 1) % 4 = 0 THEN CAST((k + 1) // 4 AS VARCHAR) ELSE rtrim(CAST(CAST((k + 1) / 4.0 AS DECIMAL(12,6)) AS VARCHAR), '0') END || ' ×' AS value FROM k
UNION ALL SELECT event_id, 'White balance blue gain', '0.5 ×' FROM k
UNION ALL SELECT event_id, 'White balance warmth', CASE WHEN k % 3 = 0 THEN 'Neutral' WHEN k % 3 = 1 THEN '1 toward blue' ELSE '2 toward blue' END FROM k
UNION ALL SELECT event_id, 'White balance tint', '1.5 toward magenta' FROM k
UNION ALL SELECT event_id, 'Contrast adjustment', CAST(k AS VARCHAR) FROM k""")
def derived_settings(spark, folder):
    k = F.from_json("props", "k int")["k"]
    rows = table(spark, folder, "events").select("event_id", k.alias("k"))
    tags = F.create_map(
        F.lit("Sony:WB_RGBLevels"), F.concat((F.col("k") + 1).cast("string"), F.lit(" 4 2")),
        F.lit("Sony:WBShiftAB_GM"), F.concat(F.lit("["), (-(F.col("k") % 3)).cast("string"), F.lit(", 1.5]")),
        F.lit("Sony:Contrast"), F.col("k").cast("string"),
    )
    return camera.photo_settings(rows.withColumn("tags", tags), ["event_id"], "tags")


@query("settings_overlay", """SELECT n.n_nationkey, n.n_name, CASE WHEN n.n_nationkey % 3 = 0 THEN n.n_regionkey * 2 ELSE r.r_regionkey END AS low,
  CASE WHEN n.n_nationkey % 4 = 0 THEN 'custom' ELSE r.r_name END AS label FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""")
def settings_overlay(spark, folder):
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    base = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "n_name", F.col("r_regionkey").alias("low"), F.col("r_name").alias("label")
    )
    over = nation.select(
        "n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, F.col("n_regionkey") * 2).alias("low"),
        F.when(F.col("n_nationkey") % 4 == 0, "custom").alias("label"),
    )
    return overlay.with_overrides(base, over, ["n_nationkey"], ["low", "label"])


@query("stale_groups", """SELECT c_custkey, md5('{"c00":"' || c_mktsegment || '","c01":' || c_nationkey || '.0}') AS config_hash FROM customer WHERE c_custkey % 3 <> 0 OR c_nationkey > 20""")
def stale_groups(spark, folder):
    rows = table(spark, folder, "customer")
    hashed = lambda nation: overlay.fingerprint(F.col("c_mktsegment"), nation.cast("double")).alias("config_hash")
    settings = rows.select("c_custkey", hashed(F.col("c_nationkey")))
    old = F.when(F.col("c_nationkey") > 20, F.col("c_nationkey") - 1).otherwise(F.col("c_nationkey"))
    state = rows.select("c_custkey", hashed(old), (F.col("c_custkey") % 3 == 0).alias("done"))
    return overlay.stale_groups(settings, state, "c_custkey", "config_hash")


@query("invalidate_stages", """SELECT n_nationkey, s.stage, NOT (n_nationkey % 2 = 0 AND s.stage IN ('track', 'export')) AS done,
  CASE WHEN NOT (n_nationkey % 2 = 0 AND s.stage IN ('track', 'export')) THEN n_name END AS config_hash
FROM nation, (VALUES ('prepare'), ('track'), ('export')) s(stage)""")
def invalidate_stages(spark, folder):
    nation = table(spark, folder, "nation")
    state = nation.select(
        "n_nationkey", F.explode(F.array(F.lit("prepare"), F.lit("track"), F.lit("export"))).alias("stage"),
        F.lit(True).alias("done"), F.col("n_name").alias("config_hash"),
    )
    return overlay.invalidate(state, "n_nationkey", nation.where("n_nationkey % 2 = 0"), ["prepare", "track", "export"], "track")


@query("even_sample", """WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS j,
  count(*) OVER (PARTITION BY o_custkey) AS size FROM orders)
SELECT o_custkey, o_orderkey FROM n WHERE size <= 8 OR EXISTS (SELECT 1 FROM range(8) r(i) WHERE CAST(floor(i * (size / 8.0)) AS BIGINT) = j)""")
def even_sample(spark, folder):
    return series.even_sample(table(spark, folder, "orders"), 8, ["o_orderkey"], ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("compare_outputs", """SELECT o_orderkey, CASE WHEN o_orderkey % 29 = 0 THEN 'removed' WHEN o_orderkey % 31 = 0 THEN 'added' ELSE 'changed' END AS change
FROM orders WHERE (o_orderkey % 29 = 0) <> (o_orderkey % 31 = 0) OR (o_orderkey % 37 = 0 AND o_orderkey % 29 <> 0 AND o_orderkey % 31 <> 0)""")
def compare_outputs(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    before = rows.where("o_orderkey % 31 <> 0")
    after = rows.where("o_orderkey % 29 <> 0").withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") % 37 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    )
    return series.compare_outputs(before, after, ["o_orderkey"])


DIGEST_WORDS = ", ".join(f"bit_xor(w{k}) AS digest_xor_{k}, CAST(sum(w{k}) AS BIGINT) AS digest_sum_{k}" for k in range(8))
DIGEST_PARTS = ", ".join(f"CAST('0x' || substr(d, {8 * k + 1}, 8) AS BIGINT) AS w{k}" for k in range(8))


@query("content_digest", f"""WITH d AS (SELECT o_orderstatus, sha256('{{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '"}}') AS d FROM orders), h AS (SELECT o_orderstatus, {DIGEST_PARTS} FROM d)
SELECT o_orderstatus, count(*) AS n_rows, {DIGEST_WORDS} FROM h GROUP BY 1""")
def content_digest(spark, folder):
    return series.digest_rows(table(spark, folder, "orders"), ["o_orderkey", "o_custkey", "o_orderpriority"], ["o_orderstatus"])


@query("identity_guard", "SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey % 5 <> 0")
def identity_guard(spark, folder):
    """Stored identities of every fifth series miss their first image."""
    now = table(spark, folder, "orders").withColumn("path", F.col("o_orderkey").cast("string"))
    first = now.groupBy("o_custkey").agg(F.min("path").alias("path")).where("o_custkey % 5 = 0")
    stored = series.series_identity(now.join(first, ["o_custkey", "path"], "left_anti"), "o_custkey", "o_orderdate", "path")
    return series.reusable(stored, now, "o_custkey", "o_orderdate", "path").select("o_custkey")


STATUS = """judged AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'excluded' WHEN o_orderkey % 23 = 0 THEN 'edited'
  WHEN o_orderkey % 19 = 0 THEN 'override' WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderstatus = 'F' AND o_custkey % 4 <> 0 THEN 'done'
  WHEN o_orderstatus = 'F' THEN 'outdated' ELSE 'pending' END AS status FROM orders)"""


def statuses(spark, folder):
    key, state = F.col("o_orderkey"), F.col("o_orderstatus")
    status = series.image_status(key % 10 == 0, key % 23 == 0, key % 19 == 0, state == "P", state == "F", F.col("o_custkey") % 4 != 0)
    return table(spark, folder, "orders").select("o_custkey", "o_orderkey", status.alias("status"))


@query("image_status", f"WITH {STATUS} SELECT * FROM judged")
def image_status(spark, folder):
    return statuses(spark, folder)


@query("group_status", f"""WITH {STATUS}, g AS (SELECT o_custkey, count(*) FILTER (status <> 'excluded') AS total,
  count(*) FILTER (status IN ('done', 'override', 'edited')) AS done, count(*) FILTER (status = 'running') AS r, count(*) FILTER (status = 'outdated') AS o FROM judged GROUP BY 1)
SELECT o_custkey, total, done, CASE WHEN total = 0 THEN 'excluded' WHEN total = done THEN 'done' WHEN r > 0 THEN 'running' WHEN o > 0 THEN 'outdated' ELSE 'pending' END AS status FROM g""")
def group_status(spark, folder):
    return series.group_status(statuses(spark, folder), ["o_custkey"], "status")
