"""Readable camera settings from raw tag maps (``group:tag`` to text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Readable setting, its tags in order of preference, and its unit.
FIELDS = (
    ("Exposure time", ("ExposureTime",), "s"),
    ("Aperture", ("FNumber", "Aperture"), "f"),
    ("ISO sensitivity", ("ISO", "PhotographicSensitivity", "ISOSpeedRatings", "ISOSetting"), "number"),
    ("Exposure compensation", ("ExposureCompensation", "ExposureBiasValue"), "EV"),
    ("Exposure mode", ("ExposureProgram", "ExposureMode"), ""),
    ("Light metering", ("MeteringMode",), ""),
    ("Focal length", ("FocalLength",), "mm"),
    ("Lens", ("LensModel", "LensID"), ""),
    ("Focus mode", ("FocusMode", "AFMode"), ""),
    ("Autofocus area", ("AFAreaModeSetting", "AFAreaMode"), ""),
    ("Focus tracking", ("AFTracking",), ""),
    ("Focus distance", ("SubjectDistance", "FocusDistance"), "m"),
    ("Estimated focus distance", ("FocusDistance2",), "m"),
    ("White balance", ("WhiteBalance",), ""),
    ("White balance red gain", ("RedBalance",), "gain"),
    ("White balance blue gain", ("BlueBalance",), "gain"),
    ("White balance warmth", ("WBWarmth",), "warmth"),
    ("White balance tint", ("WBTint",), "tint"),
    ("White balance fine adjustment", ("WBFineAdjustment",), "number"),
    ("Color tint filter", ("ColorTintFilter",), "tint"),
    ("Contrast adjustment", ("ContrastAdjustment",), "number"),
    ("Saturation adjustment", ("SaturationAdjustment",), "number"),
    ("Sharpness adjustment", ("SharpnessAdjustment",), "number"),
    ("Hue adjustment", ("HueAdjustment",), "number"),
    ("Color temperature", ("ColorTemperature",), "K"),
    ("Flash", ("Flash", "FlashAction"), ""),
    ("Flash mode", ("FlashMode",), ""),
    ("Flash compensation", ("FlashExposureComp", "FlashExposureCompensation"), "EV"),
    ("Contrast", ("Contrast",), ""),
    ("Saturation", ("Saturation",), ""),
    ("Sharpness", ("Sharpness",), ""),
    ("Brightness adjustment", ("Brightness",), "number"),
    ("Color style", ("CreativeStyle", "PictureStyle", "FilmMode", "ColorMode"), ""),
    ("Picture profile", ("PictureProfile",), ""),
    ("Picture effect", ("PictureEffect", "PictureEffect2"), ""),
    ("Scene mode", ("SceneMode", "SceneCaptureType"), ""),
    ("Color space", ("ColorSpace",), ""),
    ("Image quality", ("Quality",), ""),
    ("High dynamic range", ("HDRSetting", "HDR"), ""),
    ("Shadow and highlight adjustment", ("DynamicRangeOptimizer", "ActiveDLighting"), ""),
    ("Long-exposure noise reduction", ("LongExposureNoiseReduction",), ""),
    ("High-ISO noise reduction", ("HighISONoiseReduction", "NoiseReduction"), ""),
    ("Multi-frame noise reduction", ("MultiFrameNoiseReduction",), ""),
    ("Image stabilization", ("ImageStabilization", "Anti-Blur", "VibrationReduction"), ""),
    ("Dark-corner correction", ("VignettingCorrection", "PeripheralIlluminationCorr"), ""),
    ("Color-fringe correction", ("LateralChromaticAberration", "ChromaticAberrationCorrection"), ""),
    ("Lens distortion correction", ("DistortionCorrectionSetting", "DistortionCorrection"), ""),
    ("Digital zoom", ("DigitalZoomRatio",), "×"),
    ("Sensor crop", ("APS-CSizeCapture",), ""),
    ("Electronic first shutter curtain", ("ElectronicFrontCurtainShutter",), ""),
    ("Skin smoothing", ("SoftSkinEffect",), ""),
    ("Orientation", ("Orientation", "CameraOrientation"), ""),
)

# Standard numeric codes per tag.
CODES = {
    "WhiteBalance": {0: "Auto", 1: "Manual"},
    "ExposureProgram": {1: "Manual", 2: "Auto", 3: "Aperture priority", 4: "Shutter priority",
                        5: "Creative", 6: "Action", 7: "Portrait", 8: "Landscape"},
    "ExposureMode": {0: "Auto", 1: "Manual", 2: "Exposure bracketing"},
    "MeteringMode": {1: "Average", 2: "Center-weighted", 3: "Spot", 4: "Multi-spot", 5: "Multi-segment", 6: "Partial"},
    "Contrast": {0: "Normal", 1: "Low", 2: "High"},
    "Saturation": {0: "Normal", 1: "Low", 2: "High"},
    "Sharpness": {0: "Normal", 1: "Soft", 2: "Hard"},
    "SceneCaptureType": {0: "Standard", 1: "Landscape", 2: "Portrait", 3: "Night"},
    "ColorSpace": {1: "sRGB", 2: "Adobe RGB"},
    "Orientation": {1: "Normal", 2: "Mirrored horizontally", 3: "Rotated 180°",
                    4: "Mirrored vertically", 5: "Mirrored and rotated 270°",
                    6: "Rotated 90° clockwise", 7: "Mirrored and rotated 90°",
                    8: "Rotated 90° counterclockwise"},
}

# Tag groups without settings, and the groups of the standard.
IGNORED_GROUPS = ("IFD1", "System", "File", "InteropIFD", "GPS", "ThumbnailIFD")
STANDARD_GROUPS = ("ExifIFD", "EXIF", "IFD0")

# Vendor tags that become settings of their own.
VENDOR_TAGS = (
    ("ColorCompensationFilter", "ColorTintFilter"),
    ("WhiteBalanceFineTune", "WBFineAdjustment"),
    ("Contrast", "ContrastAdjustment"),
    ("Saturation", "SaturationAdjustment"),
    ("Sharpness", "SharpnessAdjustment"),
)
MAX_DENOMINATOR = 1_000_000


def _trim(decimal_text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(decimal_text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _general_text(value: Column, power: Column, lead: Column) -> Column:
    """Six significant digits without trailing zeros; powers of ten outside 1e-4 .. 1e6."""
    factor = F.pow(F.lit(10.0), 5 - power)
    plain = _trim((F.round(F.abs(value) * factor) / factor).cast("decimal(38,12)").cast("string"))
    scientific = F.concat(
        _trim(lead.cast("decimal(20,10)").cast("string")), F.lit("e"),
        F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"),
    )
    digits = F.when(power.between(-4, 5), plain).otherwise(scientific)
    return F.when(value == 0, F.lit("0")).otherwise(F.concat(F.when(value < 0, "-").otherwise(""), digits))


def parse_number(text: Column) -> Column:
    """Decimal or ``a/b`` fraction as double; null when it is neither."""
    fraction = r"^\s*([+-]?\d+)/(\d+)\s*$"
    top = F.regexp_extract(text, fraction, 1).try_cast("double")
    bottom = F.regexp_extract(text, fraction, 2).try_cast("double")
    decimal = F.when(text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(text).try_cast("double"))
    return F.coalesce(decimal, F.try_divide(top, bottom))


def as_fraction(value: Column) -> Column:
    """Closest fraction text with a denominator up to one million, for 0 < value < 1.

    Convergents of the continued fraction are folded until the denominator would grow too
    large; the last step then compares the best semiconvergent with the last convergent.
    """
    start = F.struct(
        F.lit(0).cast("long").alias("p0"), F.lit(1).cast("long").alias("q0"),
        F.lit(1).cast("long").alias("p1"), F.lit(0).cast("long").alias("q1"),
        F.round(value * 1e15).cast("long").alias("n"), F.lit(10**15).cast("long").alias("d"),
        F.lit(False).alias("stop"),
    )

    def step(s, _):
        whole = F.when(s["d"] != 0, F.try_divide(s["n"] - F.try_mod(s["n"], s["d"]), s["d"]).cast("long"))
        q2 = s["q0"] + whole * s["q1"]
        done = s["stop"] | (s["d"] == 0) | (q2 > MAX_DENOMINATOR)
        moved = F.struct(
            s["p1"].alias("p0"), s["q1"].alias("q0"),
            (s["p0"] + whole * s["p1"]).alias("p1"), q2.alias("q1"),
            s["d"].alias("n"), F.try_mod(s["n"], s["d"]).alias("d"), F.lit(False).alias("stop"),
        )
        halted = F.struct(*[s[c].alias(c) for c in ("p0", "q0", "p1", "q1", "n", "d")], F.lit(True).alias("stop"))
        return F.when(done, halted).otherwise(moved)

    def finish(s):
        k = F.floor((F.lit(MAX_DENOMINATOR) - s["q0"]) / s["q1"]).cast("long")
        pa, qa = s["p0"] + k * s["p1"], s["q0"] + k * s["q1"]
        exact = s["d"] == 0
        closer = exact | (F.abs(s["p1"] / s["q1"] - value) <= F.abs(pa / qa - value))
        p = F.when(closer, s["p1"]).otherwise(pa)
        q = F.when(closer, s["q1"]).otherwise(qa)
        return F.when(q == 1, p.cast("string")).otherwise(F.concat(p.cast("string"), F.lit("/"), q.cast("string")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, step, finish)


def readable(df: DataFrame, group: str, tag: str, value: str, unit: str, into: str = "value") -> DataFrame:
    """Add the readable text of one tag per row; null for unknown, binary or undecoded values.

    Intermediate results are columns of their own, so every expression is evaluated once.
    """
    kept = df.columns
    text, u, number = F.col("_text"), F.col(unit), F.col("_number")
    hidden = (
        (text == "")
        | F.lower(text).rlike("^(unknown|undefined|n/a|unrecognized|unclassified)")
        | text.contains("SHA-256")
        | text.rlike(r"^(\{|\[|base64:|\(Binary)")
    )
    bare = F.regexp_replace(text, r"^f/", "")
    rows = (
        df.withColumn("_text", F.trim(F.col(value)))
        .withColumn("_hidden", hidden)
        .withColumn("_bare", F.when((u != "") & ~F.col("_hidden"), bare))
        .withColumn(
            "_bare",
            F.trim(F.when(F.endswith("_bare", u), F.substr("_bare", F.lit(1), F.length("_bare") - F.length(u))).otherwise(F.col("_bare"))),
        )
        .withColumn("_number", parse_number(F.col("_bare")))
        .withColumn("_scale", F.floor(F.log10(F.abs(number))))
        .withColumn("_mantissa", F.round(F.abs(number) / F.pow(F.lit(10.0), F.col("_scale")), 5))
        .withColumn("_power", F.when(F.col("_mantissa") >= 10, F.col("_scale") + 1).otherwise(F.col("_scale")))
        .withColumn("_lead", F.when(F.col("_mantissa") >= 10, F.col("_mantissa") / 10.0).otherwise(F.col("_mantissa")))
        .withColumn("_general", _general_text(number, F.col("_power"), F.col("_lead")))
        .withColumn(
            "_shown",
            F.when((u == "s") & (number > 0) & (number < 1), as_fraction(number)).otherwise(F.col("_general")),
        )
    )
    side = F.when(u == "warmth", F.when(number > 0, "amber").otherwise("blue")).otherwise(
        F.when(number > 0, "magenta").otherwise("green")
    )
    toward = F.concat(F.regexp_replace("_general", "^-", ""), F.lit(" toward "), side)
    gain = F.when(number > 0, F.concat(_trim(F.round(number, 6).cast("decimal(38,6)").cast("string")), F.lit(" ×")))
    measured = (
        F.when((u == "m") & F.lower(text).isin("inf", "infinity"), F.lit("Infinity"))
        .when((u == "K") & (F.lower(text) == "auto"), text)
        .when(number.isNull(), F.lit(None).cast("string"))
        .when(u.isin("warmth", "tint"), F.when(number == 0, F.lit("Neutral")).otherwise(toward))
        .when(u == "gain", gain)
        .when(u == "f", F.concat(F.lit("f/"), "_shown"))
        .when(u == "number", F.col("_shown"))
        .otherwise(F.concat("_shown", F.lit(" "), u))
    )
    names = F.create_map(
        *[F.lit(item) for t, codes in CODES.items() for c, name in codes.items() for item in (f"{t}:{c}", name)]
    )
    code = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))
    decoded = F.when(
        F.col(group).isin(*STANDARD_GROUPS),
        F.when(F.col(tag) == "Flash", F.when(F.col("_code") % 2 != 0, "Fired").otherwise("Did not fire"))
        .otherwise(F.try_element_at(names, F.concat(F.col(tag), F.lit(":"), F.col("_code").cast("string")))),
    )
    plain = F.when(F.col("_code").isNull(), text).otherwise(decoded)
    shown = F.when(~F.col("_hidden"), F.when(u != "", measured).otherwise(plain))
    return rows.withColumn("_code", code).withColumn("_into", shown).select(
        *[c for c in kept if c != into], F.col("_into").alias(into)
    )


def numbers(value: Column, count: int) -> Column:
    """``count`` finite numbers from ``"1 2 3"`` or ``"[1, 2, 3]"``, else null."""
    parts = F.split(F.trim(F.regexp_replace(value, r"[\[\],]", " ")), r"\s+")
    parsed = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, '"', "")).try_cast("double"))
    good = (F.size(parsed) == count) & F.forall(parsed, lambda n: n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")))
    return F.when(good, parsed)


def tag_rows(images: DataFrame, keys, tags: str) -> DataFrame:
    """(keys, key, raw) of every tag plus the ``Derived:`` tags, which replace equal raw keys.

    Derived are the white-balance gains relative to green and the vendor's own adjustments.
    """
    first_levels = F.try_element_at(
        F.array_sort(F.filter(F.map_entries(tags), lambda e: e["key"].rlike("(^|:)WB_RGBLevels$") & numbers(e["value"], 3).isNotNull())),
        F.lit(1),
    )
    rows = (
        images.withColumn("_levels", numbers(first_levels["value"], 3))
        .withColumn("_precise", numbers(F.try_element_at(tags, F.lit("Sony:WBShiftAB_GM_Precise")), 2))
        .withColumn("_coarse", numbers(F.try_element_at(tags, F.lit("Sony:WBShiftAB_GM")), 2))
        .withColumn("_shift", F.coalesce("_precise", "_coarse"))
    )
    levels, shift = F.col("_levels"), F.col("_shift")
    lit = F.forall(levels, lambda v: v > 0)

    def entry(key: str, value: Column) -> Column:
        return F.struct(F.lit(f"Derived:{key}").alias("key"), value.cast("string").alias("value"))

    added = F.array(
        entry("RedBalance", F.when(lit, levels[0] / levels[1])),
        entry("BlueBalance", F.when(lit, levels[2] / levels[1])),
        entry("WBWarmth", shift[0]),
        entry("WBTint", shift[1]),
        *[entry(target, F.try_element_at(tags, F.lit(f"Sony:{source}"))) for source, target in VENDOR_TAGS],
    )
    rows = rows.withColumn("_added", F.filter(added, lambda e: e["value"].isNotNull())).withColumn(
        "_names", F.transform("_added", lambda e: e["key"])
    )
    kept = F.filter(
        F.map_entries(tags), lambda e: ~(e["key"].startswith("Derived:") & F.array_contains("_names", e["key"]))
    )
    return rows.select(*keys, F.explode(F.concat(kept, "_added")).alias("_e")).select(
        *keys, F.col("_e.key").alias("key"), F.col("_e.value").alias("raw")
    )


def catalogue(spark) -> DataFrame:
    rows = [(tag, name, order, unit) for name, tags, unit in FIELDS for order, tag in enumerate(tags)]
    return spark.createDataFrame(rows, "tag string, setting string, tag_order int, unit string")


def photo_settings(images: DataFrame, keys, tags: str) -> DataFrame:
    """(keys, setting, value): one readable value per setting, standard groups first."""
    cut = F.length(F.substring_index(F.col("key"), ":", -1))
    long = (
        tag_rows(images, keys, tags)
        .where(F.col("key").contains(":"))
        .withColumn("tag", F.substring_index("key", ":", -1))
        .withColumn("tag_group", F.substr("key", F.lit(1), F.length("key") - cut - 1))
        .where(~F.col("tag_group").isin(*IGNORED_GROUPS))
    )
    priority = (
        F.when(F.col("tag_group").isin(*STANDARD_GROUPS), 0)
        .when(F.col("tag_group") == "Derived", 3)
        .when(F.col("tag_group") == "Composite", 2)
        .otherwise(1)
    )
    # The catalogue is a fixed list of fewer than 80 tags.
    named = long.join(F.broadcast(catalogue(images.sparkSession)), "tag").withColumn("order", priority)
    # Few different values recur in very many images: each is made readable once.
    kinds = readable(named.select("tag", "tag_group", "unit", "raw").distinct(), "tag_group", "tag", "raw", "unit")
    shown = named.join(kinds, ["tag", "tag_group", "unit", "raw"])
    # The null test sits above the aggregate: as a filter on ``value`` it would be pushed down
    # through the formatting steps, repeating all of them inside one predicate.
    rank = F.when(F.col("value").isNotNull(), F.struct("tag_order", "order", "key", "raw"))
    return shown.groupBy(*keys, "setting").agg(F.min_by("value", rank).alias("value")).where("value is not null")


def flat_value(value: Column) -> Column:
    """Text as is; base64 payloads as their size and SHA-256 digest."""
    payload = F.try_to_binary(F.substring(value, 8, 2**31 - 1), F.lit("base64"))
    digest = F.concat(F.length(payload).cast("string"), F.lit(" bytes; SHA-256 "), F.sha2(payload, 256))
    return F.when(value.startswith("base64:") & payload.isNotNull(), digest).otherwise(value)
