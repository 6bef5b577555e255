"""Points, affine maps, rotated boxes and polylines as column expressions.

An affine map is an array of six doubles ``[a, b, tx, c, d, ty]``. A box is a struct
``<cx, cy, w, h, deg>`` whose centre and size are fractions of the image and whose angle is
clockwise degrees.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def affine_x(m: Column, x: Column, y: Column) -> Column:
    return m[0] * x + m[1] * y + m[2]


def affine_y(m: Column, x: Column, y: Column) -> Column:
    return m[3] * x + m[4] * y + m[5]


def affine_points(m: Column, points: Column) -> Column:
    """Map every struct<x,y> of an array."""
    return F.transform(
        points,
        lambda p: F.struct(affine_x(m, p["x"], p["y"]).alias("x"), affine_y(m, p["x"], p["y"]).alias("y")),
    )


def affine_inverse(m: Column) -> Column:
    """Inverse map; null when the map is singular."""
    det = m[0] * m[4] - m[1] * m[3]
    a, b = F.try_divide(m[4], det), F.try_divide(-m[1], det)
    c, d = F.try_divide(-m[3], det), F.try_divide(m[0], det)
    inverse = F.array(a, b, -(a * m[2] + b * m[5]), c, d, -(c * m[2] + d * m[5]))
    return F.when(det != 0, inverse)


def box(cx, cy, w, h, deg) -> Column:
    return F.struct(cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"), deg.alias("deg"))


def box_is_valid(b: Column) -> Column:
    finite = F.lit(True)
    for name in ("cx", "cy", "w", "h", "deg"):
        finite = finite & b[name].isNotNull() & ~F.isnan(b[name]) & (F.abs(b[name]) != float("inf"))
    return F.coalesce(
        finite & b["cx"].between(0, 1) & b["cy"].between(0, 1) & (b["w"] > 0) & (b["h"] > 0), F.lit(False)
    )


def box_from_bounds(x, y, width, height, image_w, image_h) -> Column:
    return box(
        (x + width / 2.0) / image_w, (y + height / 2.0) / image_h, width / image_w, height / image_h, F.lit(0.0)
    )


def box_pixels(b: Column, image_w: Column, image_h: Column) -> Column:
    return box(b["cx"] * image_w, b["cy"] * image_h, b["w"] * image_w, b["h"] * image_h, b["deg"])


def box_corners(b: Column, image_w: Column, image_h: Column) -> Column:
    """Four corners in pixels, clockwise from the box's own upper left."""
    p = box_pixels(b, image_w, image_h)
    cos, sin = F.cos(F.radians(p["deg"])), F.sin(F.radians(p["deg"]))

    def corner(sx: float, sy: float) -> Column:
        ox, oy = p["w"] * sx, p["h"] * sy
        return F.struct(
            (p["cx"] + ox * cos - oy * sin).alias("x"), (p["cy"] + ox * sin + oy * cos).alias("y")
        )

    return F.array(corner(-0.5, -0.5), corner(0.5, -0.5), corner(0.5, 0.5), corner(-0.5, 0.5))


def box_fit(b: Column, image_w: Column, image_h: Column) -> Column:
    """Shrink a rotated box just enough to fit, then move its centre inside."""
    p = box_pixels(b, image_w, image_h)
    cos, sin = F.abs(F.cos(F.radians(p["deg"]))), F.abs(F.sin(F.radians(p["deg"])))
    ex, ey = cos * p["w"] + sin * p["h"], sin * p["w"] + cos * p["h"]
    tiny = F.lit(1e-9)
    factor = F.least(F.lit(1.0), image_w / F.greatest(ex, tiny), image_h / F.greatest(ey, tiny))
    hx, hy = ex * factor / 2.0, ey * factor / 2.0
    cx = F.least(F.greatest(p["cx"], hx), image_w - hx)
    cy = F.least(F.greatest(p["cy"], hy), image_h - hy)
    return box(cx / image_w, cy / image_h, p["w"] * factor / image_w, p["h"] * factor / image_h, p["deg"])


def box_extraction(b: Column, image_w: Column, image_h: Column) -> Column:
    """struct<ok, out_w, out_h, to_source, to_crop>: output size and both maps of a crop.

    ``ok`` is false when the box is longer than the image diagonal.
    """
    p = box_pixels(b, image_w, image_h)
    out_w = F.greatest(F.lit(1.0), F.bround(p["w"]))
    out_h = F.greatest(F.lit(1.0), F.bround(p["h"]))
    cos, sin = F.cos(F.radians(p["deg"])), F.sin(F.radians(p["deg"]))
    half_w, half_h = (out_w - 1.0) / 2.0, (out_h - 1.0) / 2.0
    to_source = F.array(
        cos, -sin, p["cx"] - 0.5 - cos * half_w + sin * half_h,
        sin, cos, p["cy"] - 0.5 - sin * half_w - cos * half_h,
    )
    ok = F.greatest(p["w"], p["h"]) <= F.hypot(image_w, image_h) + 1.0
    return F.struct(
        ok.alias("ok"), out_w.cast("int").alias("out_w"), out_h.cast("int").alias("out_h"),
        to_source.alias("to_source"), affine_inverse(to_source).alias("to_crop"),
    )


def rotation(image_w: Column, image_h: Column, degrees: Column) -> Column:
    """struct<out_w, out_h, m>: clockwise rotation with the canvas grown to hold the image."""
    angle = F.radians(F.pmod(degrees, F.lit(360.0)))
    cos, sin = F.cos(angle), F.sin(angle)
    out_w = F.ceil(F.round(F.abs(cos) * image_w + F.abs(sin) * image_h, 10)).cast("double")
    out_h = F.ceil(F.round(F.abs(sin) * image_w + F.abs(cos) * image_h, 10)).cast("double")
    src_w, src_h = (image_w - 1.0) / 2.0, (image_h - 1.0) / 2.0
    m = F.array(
        cos, -sin, (out_w - 1.0) / 2.0 - cos * src_w + sin * src_h,
        sin, cos, (out_h - 1.0) / 2.0 - sin * src_w - cos * src_h,
    )
    return F.struct(out_w.cast("int").alias("out_w"), out_h.cast("int").alias("out_h"), m.alias("m"))


def box_unrotate(b: Column, image_w: Column, image_h: Column, degrees: Column) -> Column:
    """Express a box of the rotated image in the coordinates of the source image."""
    turned = rotation(image_w, image_h, degrees)
    back = affine_inverse(turned["m"])
    p = box_pixels(b, turned["out_w"].cast("double"), turned["out_h"].cast("double"))
    x = affine_x(back, p["cx"] - 0.5, p["cy"] - 0.5) + 0.5
    y = affine_y(back, p["cx"] - 0.5, p["cy"] - 0.5) + 0.5
    return box(x / image_w, y / image_h, p["w"] / image_w, p["h"] / image_h, p["deg"] - degrees)


def inside_polygon(x: Column, y: Column, corners: Column) -> Column:
    """Inside test for a clockwise quadrilateral (image coordinates), borders included."""
    inside = F.lit(True)
    for i in range(4):
        a, b = corners[i], corners[(i + 1) % 4]
        inside = inside & ((b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]) >= 0)
    return inside


def margin_pixels(fraction: float, length: Column) -> Column:
    return F.bround(length * F.lit(float(fraction))).cast("int")


def polyline_length(points: Column) -> Column:
    """Length of array<array<double>> points of any one dimension."""
    steps = F.zip_with(
        F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))),
        F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))),
        lambda a, b: F.sqrt(
            F.aggregate(
                F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, v: acc + v
            )
        ),
    )
    return F.aggregate(steps, F.lit(0.0), lambda acc, v: acc + v)


def polyline_depth(points: Column) -> Column:
    ys = F.transform(points, lambda p: p[1])
    return F.coalesce(F.array_max(ys) - F.array_min(ys), F.lit(0.0))


def analysis_box(image_w: Column, image_h: Column, top: Column, bottom: Column, margins: Column, own: Column | None = None) -> Column:
    """Fixed box inside a plate: between two shares of its height, less margins; ``own`` wins where it is given.

    ``margins`` is struct<top, bottom, left, right> of shares; those of the height refer to the part between the two.
    """
    first, last = F.bround(image_h * top), F.bround(image_h * bottom)
    part = last - first
    up, down, left, right = (F.bround(margins[n] * size) for n, size in (("top", part), ("bottom", part), ("left", image_w), ("right", image_w)))
    one = F.lit(1.0)
    fixed = box_from_bounds(left, first + up, F.greatest(one, image_w - left - right), F.greatest(one, part - up - down), image_w, image_h)
    return fixed if own is None else F.coalesce(own, fixed)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def search_frame(image_w: Column, image_h: Column, degrees: Column, own: Column) -> Column:
    """struct<w, h, m>: where plates are looked for, with the map from the image: the ``own`` box, or the turned image."""
    def frame(found: Column, m: str) -> Column:
        return _let(found, lambda v: F.struct(v["out_w"].alias("w"), v["out_h"].alias("h"), v[m].alias("m")))

    return F.when(own.isNotNull(), frame(box_extraction(own, image_w, image_h), "to_crop")).otherwise(frame(rotation(image_w, image_h, degrees), "m"))


def search_box(image_w: Column, image_h: Column, degrees: Column, own: Column) -> Column:
    """The search frame as a box of the image."""
    whole = box(*[F.lit(v) for v in (0.5, 0.5, 1.0, 1.0, 0.0)])
    return F.coalesce(own, box_unrotate(whole, image_w, image_h, degrees))


def plate_outline(bounds: Column, m: Column) -> Column:
    """Corners in the image of a plate that fills ``bounds`` (x, y, width, height) of the search frame, clockwise."""
    def corners(b: Column, back: Column) -> Column:
        right, low = b["x"] + b["width"], b["y"] + b["height"]
        return F.array(*[
            F.struct((affine_x(back, x - 0.5, y - 0.5) + 0.5).alias("x"), (affine_y(back, x - 0.5, y - 0.5) + 0.5).alias("y"))
            for x, y in ((b["x"], b["y"]), (right, b["y"]), (right, low), (b["x"], low))])

    return _let(F.struct(bounds.alias("b"), _let(m, affine_inverse).alias("back")), lambda v: corners(v["b"], v["back"]))


def plate_crop(outline: Column, m: Column) -> Column:
    """struct<x, y, width, height, to_plate>: upright bounds of an outline in the search frame, and the map from the image."""
    def bounds(m: Column, line: Column) -> Column:
        xs = F.transform(line, lambda p: affine_x(m, p["x"] - 0.5, p["y"] - 0.5) + 0.5)
        ys = F.transform(line, lambda p: affine_y(m, p["x"] - 0.5, p["y"] - 0.5) + 0.5)
        return F.array(*[F.bround(f(v)).cast("int") for v in (xs, ys) for f in (F.array_min, F.array_max)])

    def crop(m: Column, e: Column) -> Column:
        moved = F.transform(m, lambda v, i: F.when(i == 2, v - e[0]).when(i == 5, v - e[2]).otherwise(v))
        return F.struct(e[0].alias("x"), e[2].alias("y"), (e[1] - e[0]).alias("width"), (e[3] - e[2]).alias("height"), moved.alias("to_plate"))

    given = F.struct(m.alias("m"), outline.alias("o"))
    return _let(given, lambda v: _let(F.struct(v["m"].alias("m"), bounds(v["m"], v["o"]).alias("e")), lambda w: crop(w["m"], w["e"])))


def plate_box(bounds: Column, image_w: Column, image_h: Column, degrees: Column) -> Column:
    """Bounds of a plate found in the turned image, as a box of the image."""
    turned = rotation(image_w, image_h, degrees)
    found = box_from_bounds(bounds["x"], bounds["y"], bounds["width"], bounds["height"], turned["out_w"], turned["out_h"])
    return box_unrotate(found, image_w, image_h, degrees)
