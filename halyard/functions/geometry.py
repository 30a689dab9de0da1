"""Regions of frames, shapes of four corners and thresholds that follow the light, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashes import js_round

RATIOS = {"3:2": 3 / 2, "2:3": 2 / 3, "1:1": 1.0}


def _region(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def visible_viewport(width: Column, height: Column, ratio: Column) -> Column:
    """The centred part of a frame with the display's aspect ratio; all of it where they agree within 0.001."""
    own = width / height
    wanted = F.when(ratio > 0, ratio).otherwise(own)
    zero = F.lit(0.0)
    narrow, low = js_round(height * wanted), js_round(width / wanted)
    whole = _region(zero, zero, width.cast("double"), height.cast("double"))
    return (
        F.when(own.isNull() | wanted.isNull() | (F.abs(own - wanted) < 0.001), whole)
        .when(own > wanted, _region(js_round((width - narrow) / 2), zero, narrow.cast("double"), height.cast("double")))
        .otherwise(_region(zero, js_round((height - low) / 2), width.cast("double"), low.cast("double")))
    )


def framed_region(width: Column, height: Column, aspect: str, scale: float = 0.8) -> Column:
    """The centred frame of an aspect ratio that fills the given share of the tighter side."""
    ratio = RATIOS.get(aspect, 1.0)
    wide = width / height > ratio
    w = F.when(wide, height * scale * ratio).otherwise(width * scale)
    h = F.when(wide, height * scale).otherwise(width * scale / ratio)
    return _region(js_round((width - w) / 2), js_round((height - h) / 2), js_round(w), js_round(h))


def shoelace(points: list[tuple[Column, Column]]) -> Column:
    """Signed area of a polygon."""
    total = F.lit(0.0)
    for (xa, ya), (xb, yb) in zip(points, [*points[1:], points[0]], strict=True):
        total = total + (xa * yb - xb * ya)
    return total / 2


def _finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def quadrilateral_ok(points: list[tuple[Column, Column]], least_area: float) -> Column:
    """Finite corners, in order, around at least the given signed area."""
    fine = F.lit(True)
    for x, y in points:
        fine = fine & _finite(x) & _finite(y)
    return fine & F.coalesce(shoelace(points) >= least_area, F.lit(False))


def perspective_ok(points: list[tuple[Column, Column]], width: Column, height: Column, least_area: float = 64.0) -> Column:
    """Finite corners inside the frame around an area of at least 64, in either order."""
    fine = F.lit(True)
    for x, y in points:
        fine = fine & _finite(x) & _finite(y) & x.between(0, width) & y.between(0, height)
    return fine & F.coalesce(F.abs(shoelace(points)) >= least_area, F.lit(False))


def rectangle_region(points: list[tuple[Column, Column]], width: Column, height: Column) -> Column:
    """struct<x, y, width, height, aspect>: the bounding box of normalised corners (top left first, clockwise) in pixels."""
    xs, ys = ([p[k] for p in points] for k in range(2))
    inside = lambda v, most: F.greatest(F.lit(0.0), F.least(most.cast("double"), v))
    left, right = inside(F.least(*xs) * width, width), inside(F.greatest(*xs) * width, width)
    top, bottom = inside(F.least(*ys) * height, height), inside(F.greatest(*ys) * height, height)
    side = lambda a, b: F.hypot((b[0] - a[0]) * width, (b[1] - a[1]) * height)
    across = (side(points[0], points[1]) + side(points[3], points[2])) / 2
    down = (side(points[0], points[3]) + side(points[1], points[2])) / 2
    return F.struct(
        F.floor(left).alias("x"), F.floor(top).alias("y"), js_round(right - left).alias("width"), js_round(bottom - top).alias("height"),
        F.when(across >= down, "3:2").otherwise("2:3").alias("aspect"),
    )


def adaptive_thresholds(
    ambient: Column, ambient_glare: Column, low: float = 50.0, high: float = 220.0, glare: float = 20.0
) -> Column:
    """struct<min_brightness, max_brightness, glare_percent> moved towards the ambient light; null light moves nothing."""
    shift = (ambient - (low + high) / 2) * 0.35
    clamp = lambda x, a, b: F.least(F.greatest(x, F.lit(a)), F.lit(b))
    dark = F.greatest(F.lit(0.0), (F.lit(160.0) - ambient) / 8)
    pick = lambda moved, base: F.when(ambient.isNull(), F.lit(base)).otherwise(moved)
    return F.struct(
        pick(clamp(F.lit(low) + shift, 20.0, low + 30), low).alias("min_brightness"),
        pick(clamp(F.lit(high) + shift, high - 30, 245.0), high).alias("max_brightness"),
        pick(clamp(F.lit(glare) + dark + F.coalesce(ambient_glare * 0.2, F.lit(0.0)), glare, 40.0), glare).alias("glare_percent"),
    )


def smoothed(values: Column, weight: float = 0.15) -> Column:
    """The exponential average after each of an array's values, the first as it is."""
    step = lambda kept, x: F.array_append(
        kept, F.when(F.size(kept) == 0, x).otherwise(F.element_at(kept, -1) * (1 - weight) + x * weight)
    )
    return F.aggregate(values, F.array().cast("array<double>"), step)


def stability(elapsed_ms: Column, delay_ms: Column) -> Column:
    """struct<elapsed_ms, remaining_ms, progress> of a candidate that is being confirmed."""
    return F.struct(
        elapsed_ms.alias("elapsed_ms"), F.greatest(delay_ms - elapsed_ms, F.lit(0)).alias("remaining_ms"),
        F.when(delay_ms > 0, F.least(elapsed_ms / delay_ms, F.lit(1.0))).otherwise(1.0).alias("progress"),
    )


def motion_limits(sensitivity: Column) -> Column:
    """struct<pixel, pixels>: how much a pixel, and how many pixels, must change to count as motion."""
    return F.struct((F.lit(30) + (100 - sensitivity) / 2).alias("pixel"), (F.lit(500) + (100 - sensitivity) * 10).alias("pixels"))
