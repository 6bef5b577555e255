"""Tone curve and its inverse fits. Control values run from -100 to 100."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: grey levels moved by one unit of a control at full weight.
GAIN = 0.5 * 255.0 / 100.0
MIN_WEIGHT = 0.05


def _control(value: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(-100.0), value))


def _unit(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def adjust(level: Column, brightness, shadows, highlights) -> Column:
    """New 8-bit level; the result is cut off, not rounded."""
    x = level / F.lit(255.0)
    scale = 0.5 / 100.0
    moved = (
        x
        + brightness * F.lit(scale)
        + shadows * F.lit(scale) * (1.0 - x) * (1.0 - x)
        + highlights * F.lit(scale) * x * x
    )
    changed = F.floor(_unit(moved) * 255.0).cast("int")
    idle = (brightness == 0) & (shadows == 0) & (highlights == 0)
    return F.when(idle, level.cast("int")).otherwise(changed)


def brightness_match(current_mean: Column, target_mean: Column) -> Column:
    return _control((target_mean - current_mean) / GAIN)


def match(current: dict[str, Column], target: dict[str, Column]) -> dict[str, Column]:
    """Controls moving three tones to the target, fitted mid, then shadow, then highlight."""
    brightness = _control((target["mid"] - current["mid"]) / GAIN)
    shift = brightness * GAIN
    dark = current["shadow"] + shift
    bright = current["highlight"] + shift
    xs, xh = _unit(dark / 255.0), _unit(bright / 255.0)
    shadows = _control(
        (target["shadow"] - dark) / (GAIN * F.greatest((1.0 - xs) * (1.0 - xs), F.lit(MIN_WEIGHT)))
    )
    reached = bright + GAIN * shadows * (1.0 - xh) * (1.0 - xh)
    highlights = _control(
        (target["highlight"] - reached) / (GAIN * F.greatest(xh * xh, F.lit(MIN_WEIGHT)))
    )
    return {"brightness": brightness, "shadows": shadows, "highlights": highlights}
