"""Box expressions. A box is the four columns xmin, ymin, xmax, ymax of a row, or another ``Box``."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


class Box(NamedTuple):
    xmin: Column
    ymin: Column
    xmax: Column
    ymax: Column

    def named(self) -> list[Column]:
        return [c.alias(n) for c, n in zip(self, self._fields, strict=True)]


def box(prefix: str = "") -> Box:
    return Box(*[F.col(prefix + n) for n in Box._fields])


def is_finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < INFINITY), F.lit(False))


def finite(b: Box) -> Column:
    return is_finite(b.xmin) & is_finite(b.ymin) & is_finite(b.xmax) & is_finite(b.ymax)


def ordered(b: Box) -> Column:
    """Finite, with minima up to maxima."""
    return finite(b) & (b.xmin <= b.xmax) & (b.ymin <= b.ymax)


def area(b: Box) -> Column:
    return (b.xmax - b.xmin) * (b.ymax - b.ymin)


def valid_area(b: Box) -> Column:
    return ordered(b) & is_finite(area(b)) & (area(b) > 0)


def outside(b: Box, width: Column, height: Column, tolerance: float = 0.5) -> Column:
    return (b.xmin < -tolerance) | (b.ymin < -tolerance) | (b.xmax > width + tolerance) | (b.ymax > height + tolerance)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for unordered boxes or an empty union."""
    w = F.greatest(F.lit(0.0), F.least(a.xmax, b.xmax) - F.greatest(a.xmin, b.xmin))
    h = F.greatest(F.lit(0.0), F.least(a.ymax, b.ymax) - F.greatest(a.ymin, b.ymin))
    union = area(a) + area(b) - w * h
    fine = ordered(a) & ordered(b) & is_finite(union) & (union > 0)
    return F.when(fine, w * h / F.nullif(union, F.lit(0.0))).otherwise(0.0)


def divided(x: Column, y: Column) -> Column:
    """IEEE division: zero divisors give an infinity or NaN."""
    zero = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(x > 0, F.lit(INFINITY)).otherwise(F.lit(-INFINITY))
    return F.when(y == 0, zero).otherwise(x / F.nullif(y.cast("double"), F.lit(0.0)))


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Box:
    return Box(x, y, x + w, y + h)


def to_xywh(b: Box) -> list[Column]:
    return [b.xmin, b.ymin, b.xmax - b.xmin, b.ymax - b.ymin]


def from_cxcywh(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def to_cxcywh(b: Box) -> list[Column]:
    return [(b.xmin + b.xmax) / 2, (b.ymin + b.ymax) / 2, b.xmax - b.xmin, b.ymax - b.ymin]


def to_pixel(b: Box, width: Column, height: Column) -> Box:
    return Box(b.xmin * width, b.ymin * height, b.xmax * width, b.ymax * height)


def to_normalized(b: Box, width: Column, height: Column) -> Box:
    return Box(divided(b.xmin, width), divided(b.ymin, height), divided(b.xmax, width), divided(b.ymax, height))


def from_percent(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Box:
    return from_xywh(x / 100 * width, y / 100 * height, w / 100 * width, h / 100 * height)


def to_percent(b: Box, width: Column, height: Column) -> list[Column]:
    n = to_normalized(b, width, height)
    return [c * 100 for c in to_xywh(n)]


def rotated_envelope(x: Column, y: Column, w: Column, h: Column, degrees: Column) -> Box:
    """The upright box around a box turned clockwise about its corner (x, y)."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    xs = [x, x + w * c, x - h * s, x + w * c - h * s]
    ys = [y, y + w * s, y + h * c, y + w * s + h * c]
    return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def envelope(points: Column, x: str = "x", y: str = "y") -> Box:
    """The box around an array of point structs."""
    xs, ys = F.transform(points, lambda p: p[x]), F.transform(points, lambda p: p[y])
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def near(a: Box, b: Box, epsilon: float = 1e-6) -> Column:
    """Each coordinate within epsilon; never for NaN."""
    same = [F.coalesce(~F.isnan(p - q) & (F.abs(p - q) <= epsilon), F.lit(False)) for p, q in zip(a, b, strict=True)]
    return same[0] & same[1] & same[2] & same[3]
