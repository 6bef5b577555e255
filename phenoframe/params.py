"""Processing parameters: defaults, documents, checks and fingerprints."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column, DataFrame, functions as F

from phenoframe.operators.overlay import fingerprint

# Names and defaults of the settings, as parameter files hold them.

@dataclass
class Data:
    filename_template: str = "{group}.{date}"
    date_format: str = "%y-%m-%d"
    input: str = "data_in_vitro/"
    output: str = "result/"
    statistics: str = "statistics_in_vitro.csv"
    detect_barcodes: bool = True
    cache_compressed: bool = False


@dataclass
class Green:
    min_count: int = 5
    min_area: int = 100
    hsv_lower: tuple = (28, 166, 50)
    hsv_upper: tuple = (42, 255, 200)


@dataclass
class Threshold:
    low: int = 20
    high: int = 30
    min_contour_area: int = 100
    min_contour_length: int = 15


@dataclass
class Registration:
    enabled: bool = True
    margin_ratio: float = 0.25


@dataclass
class Crop:
    background_enabled: bool = True
    background_region: str = "largest"
    blue_hsv_lower: tuple = (70, 0, 0)
    blue_hsv_upper: tuple = (140, 255, 255)
    top_ratio: float = 0.0
    bottom_ratio: float = 1.0


SECTIONS = {"data": Data, "green": Green, "threshold": Threshold, "registration": Registration, "crop": Crop}


@dataclass
class Params:
    margin_top: float = 0.0
    margin_bottom: float = 0.05
    margin_left: float = 0.03
    margin_right: float = 0.03
    rotation: float = 180
    load_roi: tuple | None = None
    preprocess_roi: tuple | None = None
    n_clusters: int = 6
    data: Data = field(default_factory=Data)
    green: Green = field(default_factory=Green)
    threshold: Threshold = field(default_factory=Threshold)
    registration: Registration = field(default_factory=Registration)
    crop: Crop = field(default_factory=Crop)

    @classmethod
    def from_dict(cls, raw: dict) -> "Params":
        """Read nested settings; viewer preferences (``gui``) are accepted and dropped."""
        if not isinstance(raw, dict):
            raise ValueError("parameters must be named settings")
        values = {k: v for k, v in raw.items() if k != "gui"}
        sections = {}
        for name, kind in SECTIONS.items():
            given = dict(values.pop(name, {}) or {})
            given.pop("show_max_root_depth", None)  # an old preview option
            sections[name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
        return cls(**sections, **{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})

    @classmethod
    def from_file(cls, path: str) -> "Params":
        with open(path, encoding="utf-8") as stream:
            text = stream.read()
        if path.endswith(".json"):
            return cls.from_dict(json.loads(text))
        try:
            import yaml
        except ImportError as error:
            raise ValueError("reading YAML needs the yaml module; use JSON") from error
        return cls.from_dict(yaml.safe_load(text))

    def to_dict(self) -> dict:
        return json.loads(json.dumps(asdict(self)))

    def to_json(self) -> str:
        return json.dumps(self.to_dict())

    def flat(self) -> dict:
        """One level of names such as ``threshold_low``; tuples become lists."""
        out = {}
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name in SECTIONS:
                out |= {f"{f.name}_{k}": list(v) if isinstance(v, tuple) else v for k, v in asdict(value).items()}
            else:
                out[f.name] = list(value) if isinstance(value, tuple) else value
        return out


def settings_table(groups: DataFrame, group: str, params: Params) -> DataFrame:
    """One settings row per group with the default parameters; overlay group overrides on it."""
    def literal(name, value):
        if value is None:
            return F.lit(None).cast("array<double>").alias(name)
        if isinstance(value, list):
            return F.array(*[F.lit(v) for v in value]).alias(name)
        if isinstance(value, float):
            return F.lit(value).alias(name)
        return F.lit(value).alias(name)

    return groups.select(group, *[literal(k, v) for k, v in params.flat().items()])


def _hsv_bad(name: str) -> Column:
    low, high = F.col(f"{name}_lower"), F.col(f"{name}_upper")
    bad = (F.size(low) != 3) | (F.size(high) != 3)
    for i, top in enumerate((179, 255, 255)):
        bad = bad | ~F.get(low, F.lit(i)).between(0, top) | ~F.get(high, F.lit(i)).between(0, top)
        if i:
            bad = bad | (F.get(low, F.lit(i)) > F.get(high, F.lit(i)))
    return bad


def _roi_bad(name: str) -> Column:
    box = F.col(name)
    inside = F.get(box, F.lit(0)).between(0, 1) & F.get(box, F.lit(1)).between(0, 1)
    sized = (F.get(box, F.lit(2)) > 0) & (F.get(box, F.lit(3)) > 0)
    finite = F.forall(box, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    return box.isNotNull() & ~F.coalesce((F.size(box) == 5) & inside & sized & finite, F.lit(False))


def violation_rules() -> dict[str, Column]:
    """Named predicates that are true when a settings row breaks a constraint."""
    c = F.col
    rules = {f"{m} outside 0..1": ~c(m).between(0, 1) for m in ("margin_top", "margin_bottom", "margin_left", "margin_right")}
    rules |= {
        "opposite margins leave nothing": (c("margin_top") + c("margin_bottom") >= 1) | (c("margin_left") + c("margin_right") >= 1),
        "crop ratios out of order": ~((c("crop_top_ratio") >= 0) & (c("crop_top_ratio") < c("crop_bottom_ratio")) & (c("crop_bottom_ratio") <= 1)),
        "thresholds out of order": ~((c("threshold_low") >= 0) & (c("threshold_low") <= c("threshold_high")) & (c("threshold_high") <= 255)),
        "search margin outside 0..1": ~c("registration_margin_ratio").between(0, 1),
        "rotation not finite": F.isnan(c("rotation")) | (F.abs(c("rotation")) == float("inf")),
        "no plants": c("n_clusters") < 1,
        "unknown background region": ~c("crop_background_region").isin("largest", "all"),
        "negative size limit": (F.least("green_min_count", "green_min_area", "threshold_min_contour_area", "threshold_min_contour_length") < 0),
        "green range": _hsv_bad("green_hsv"),
        "blue range": _hsv_bad("crop_blue_hsv"),
        "load box": _roi_bad("load_roi"),
        "analysis box": _roi_bad("preprocess_roi"),
    }
    return rules


def violations(settings: DataFrame, group: str) -> DataFrame:
    """(group, violation): one row per broken constraint; a null value breaks its constraint."""
    broken = F.array(*[F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in violation_rules().items()])
    return settings.select(group, F.explode(F.array_compact(broken)).alias("violation"))


PREPARE_KEYS = (
    "data_filename_template", "data_date_format", "rotation", "n_clusters", "margin_top", "margin_bottom", "margin_left",
    "margin_right", "green_min_count", "green_min_area", "green_hsv_lower", "green_hsv_upper", "crop_top_ratio",
    "crop_bottom_ratio", "crop_blue_hsv_lower", "crop_blue_hsv_upper", "crop_background_enabled", "crop_background_region",
    "registration_enabled", "registration_margin_ratio", "load_roi", "preprocess_roi",
)
TRACK_KEYS = (
    "data_filename_template", "data_date_format", "threshold_low", "threshold_high", "threshold_min_contour_area",
    "threshold_min_contour_length", "n_clusters", "margin_top", "margin_bottom", "margin_left", "margin_right",
)


def stage_hashes(settings: DataFrame) -> DataFrame:
    """Add prepare_hash and track_hash; whole and fractional numbers of equal value agree."""
    kinds = dict(settings.dtypes)
    def plain(name):
        return F.col(name).cast("double") if kinds[name] in ("int", "bigint", "double", "float") or kinds[name].startswith("decimal") else F.col(name)
    return settings.withColumn("prepare_hash", fingerprint(*[plain(k) for k in PREPARE_KEYS])).withColumn(
        "track_hash", fingerprint(*[plain(k) for k in TRACK_KEYS])
    )
