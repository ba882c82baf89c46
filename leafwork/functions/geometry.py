"""Boxes as four double columns: overlap, clipping, padding and changes of coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{n}") for n in ("x0", "y0", "x1", "y1"))


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def overlap(a: Box, b: Box) -> Column:
    """Area that two boxes share, 0 if they only touch."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a: Box, b: Box) -> Column:
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(0.0)


def share_inside(inner: Box, outer: Box) -> Column:
    """Part of the inner box that lies in the outer one; null for an inner box without area."""
    return F.try_divide(overlap(inner, outer), area(inner))


def clip(b: Box, w: float, h: float) -> Box:
    x0, y0 = F.greatest(F.lit(0.0), F.least(b[0], F.lit(w - 1.0))), F.greatest(F.lit(0.0), F.least(b[1], F.lit(h - 1.0)))
    return x0, y0, F.greatest(x0 + 1, F.least(b[2], F.lit(float(w)))), F.greatest(y0 + 1, F.least(b[3], F.lit(float(h))))


def clamp(b: Box, w: float, h: float) -> Box:
    x0, x1 = (F.greatest(F.lit(0.0), F.least(v, F.lit(float(w)))) for v in (b[0], b[2]))
    y0, y1 = (F.greatest(F.lit(0.0), F.least(v, F.lit(float(h)))) for v in (b[1], b[3]))
    return F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1)


def shrink(b: Box, part: float) -> Box:
    dx, dy = F.greatest(F.lit(1.0), b[2] - b[0]) * part, F.greatest(F.lit(1.0), b[3] - b[1]) * part
    return b[0] + dx, b[1] + dy, b[2] - dx, b[3] - dy


def expand(b: Box, pad: float, w: float, h: float) -> Box:
    if pad <= 0:
        return b
    flat = (b[2] <= b[0]) | (b[3] <= b[1])
    out = F.greatest(F.lit(0.0), b[0] - pad), F.greatest(F.lit(0.0), b[1] - pad), F.least(F.lit(float(w)), b[2] + pad), F.least(F.lit(float(h)), b[3] + pad)
    return tuple(F.when(flat, old).otherwise(new) for old, new in zip(b, out))


def project(b: Box, h: list[float]) -> Box:
    """Axis-aligned hull of the corners under a 3 by 3 matrix."""
    xs, ys = [], []
    for x, y in ((b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])):
        d = x * h[6] + y * h[7] + h[8]
        xs.append((x * h[0] + y * h[1] + h[2]) / d)
        ys.append((x * h[3] + y * h[4] + h[5]) / d)
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def named(b: Box, prefix: str = "") -> list[Column]:
    return [c.alias(f"{prefix}{n}") for c, n in zip(b, ("x0", "y0", "x1", "y1"))]
