"""Affine matrices, mapping modes and physical sizes, as native expressions. Vectors are rows: x' = x*m11 + y*m21 + dx."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units per millimetre of the mapping modes 2 to 6.
UNITS_PER_MM = {2: 10.0, 3: 100.0, 4: 100 / 25.4, 5: 1000 / 25.4, 6: 1440 / 25.4}


def apply(m: dict[str, Column], x: Column, y: Column) -> tuple[Column, Column]:
    return x * m["m11"] + y * m["m21"] + m["dx"], x * m["m12"] + y * m["m22"] + m["dy"]


def then(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """The matrix that applies a, then b."""
    return {
        "m11": a["m11"] * b["m11"] + a["m12"] * b["m21"],
        "m12": a["m11"] * b["m12"] + a["m12"] * b["m22"],
        "m21": a["m21"] * b["m11"] + a["m22"] * b["m21"],
        "m22": a["m21"] * b["m12"] + a["m22"] * b["m22"],
        "dx": a["dx"] * b["m11"] + a["dy"] * b["m21"] + b["dx"],
        "dy": a["dx"] * b["m12"] + a["dy"] * b["m22"] + b["dy"],
    }


def page_matrix(window_org: tuple, window_ext: tuple, viewport_org: tuple, viewport_ext: tuple) -> dict[str, Column]:
    """Window to viewport: scale by the extents, then move the origins onto one another."""
    sx, sy = viewport_ext[0] / window_ext[0], viewport_ext[1] / window_ext[1]
    return {"m11": sx, "m12": F.lit(0.0), "m21": F.lit(0.0), "m22": sy, "dx": viewport_org[0] - window_org[0] * sx, "dy": viewport_org[1] - window_org[1] * sy}


def mode_scale(mode: Column, pixels_per_mm: Column | tuple[Column, Column], extents: tuple[Column, Column]) -> tuple[Column, Column]:
    """Device units per logical unit: mode 1 is one to one, 2 to 6 are metric with y up, 7 and 8 keep the extents' ratios.

    ``pixels_per_mm`` is that of both axes, or one for each.
    """
    dense = pixels_per_mm if isinstance(pixels_per_mm, tuple) else (pixels_per_mm, pixels_per_mm)
    metric = lambda d: F.coalesce(*[F.when(mode == k, d / F.lit(u)) for k, u in UNITS_PER_MM.items()])
    x = F.when(mode == 1, 1.0).when(mode.between(2, 6), metric(dense[0])).when(mode.isin(7, 8), extents[0])
    y = F.when(mode == 1, 1.0).when(mode.between(2, 6), -metric(dense[1])).when(mode.isin(7, 8), extents[1])
    # Mode 7 shrinks the axis on which a unit is longer by the ruler, keeping its sign.
    wide, high = F.abs(x) / dense[0], F.abs(y) / dense[1]
    return F.when((mode == 7) & (wide > high), F.signum(x) * high * dense[0]).otherwise(x), F.when((mode == 7) & (high > wide), F.signum(y) * wide * dense[1]).otherwise(y)


def points_of_frame(left: Column, top: Column, right: Column, bottom: Column) -> tuple[Column, Column]:
    """Width and height in points of an EMF frame in hundredths of a millimetre; null if either is zero."""
    w, h = F.abs(right - left) * 72 / 2540.0, F.abs(bottom - top) * 72 / 2540.0
    fine = (w > 0) & (h > 0)
    return F.when(fine, w), F.when(fine, h)


def points_of_bounds(left: Column, top: Column, right: Column, bottom: Column, per_inch: Column) -> tuple[Column, Column]:
    """Width and height in points of placeable WMF bounds."""
    w, h = F.abs(right - left) * 72.0 / per_inch, F.abs(bottom - top) * 72.0 / per_inch
    fine = (w > 0) & (h > 0)
    return F.when(fine, w), F.when(fine, h)


def arc_angle(x: Column, y: Column, cx: Column, cy: Column, rx: Column, ry: Column) -> Column:
    """Angle of a radial in the parameter space of an ellipse, growing against the clock although y points down."""
    return F.atan2(-(y - cy) * rx, (x - cx) * ry)


def arc_sweep(start: Column, end: Column, against_clock: Column) -> Column:
    """Signed angle from one radial to the other, both from ``arc_angle``; radials of one direction make a full turn."""
    d = end - start
    return F.when(against_clock, F.when(d <= 0, d + 2 * math.pi).otherwise(d)).otherwise(F.when(d >= 0, d - 2 * math.pi).otherwise(d))


def arc_control_length(sweep: Column) -> Column:
    """Distance of the control points of a cubic that follows an arc of at most a quarter turn, in radii."""
    return F.tan(sweep / 4) * (4.0 / 3)


def spline_controls(before: Column, at: Column, after: Column, tension: Column) -> tuple[Column, Column]:
    """Control points on both sides of a knot of a cardinal spline, one axis."""
    reach = (after - before) * tension / 3
    return at - reach, at + reach


def flatten_steps(deviation: Column) -> Column:
    """Line segments for a curve whose second difference is given, for an error of a quarter unit; 1 to 256."""
    return F.least(F.lit(256), F.greatest(F.lit(1), F.ceil(F.sqrt(3 * deviation)))).cast("int")
