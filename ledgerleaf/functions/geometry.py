"""Column functions on boxes. A box is four columns; layout boxes are ymin, xmin, ymax, xmax in 0 to 1000."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    ymin: Column
    xmin: Column
    ymax: Column
    xmax: Column

    @property
    def area(self) -> Column:
        return (self.ymax - self.ymin) * (self.xmax - self.xmin)

    @property
    def center_x(self) -> Column:
        return (self.xmin + self.xmax) / 2


def box(prefix: str = "") -> Box:
    """The box in columns ``<prefix>ymin`` and so on."""
    return Box(*(F.col(prefix + c) for c in ("ymin", "xmin", "ymax", "xmax")))


def intersection(a: Box, b: Box) -> Column:
    """Shared area, 0 where boxes only touch."""
    h = F.least(a.ymax, b.ymax) - F.greatest(a.ymin, b.ymin)
    w = F.least(a.xmax, b.xmax) - F.greatest(a.xmin, b.xmin)
    return F.when((h > 0) & (w > 0), h * w).otherwise(F.lit(0)).cast("double")


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 if the union has no area. Null if a side is."""
    inter = intersection(a, b)
    union = a.area + b.area - inter
    known = a.area.isNotNull() & b.area.isNotNull()
    return F.when(known, F.when(union > 0, inter / union).otherwise(F.lit(0.0)))


def coverage(inner: Box, outer: Box) -> Column:
    """The share of ``inner`` that lies in ``outer``; 0 for an inner box without area."""
    return F.when(inner.area > 0, intersection(inner, outer) / inner.area).otherwise(F.lit(0.0))


def to_pixels(b: Box, width: int, height: int) -> list[Column]:
    """x0, y0, x1, y1 in pixels, truncated."""
    return [(b.xmin / 1000 * width).cast("int"), (b.ymin / 1000 * height).cast("int"), (b.xmax / 1000 * width).cast("int"), (b.ymax / 1000 * height).cast("int")]


def crop(b: Box, width: int, height: int, pad: int) -> list[Column]:
    """The padded crop rectangle in pixels, clipped to the page."""
    x0, y0, x1, y1 = to_pixels(b, width, height)
    return [F.greatest(F.lit(0), x0 - pad), F.greatest(F.lit(0), y0 - pad), F.least(F.lit(width), x1 + pad), F.least(F.lit(height), y1 + pad)]


def area_percentage(b: Box) -> Column:
    return b.area / 1_000_000 * 100


def in_margin(b: Box, height: float = 1000.0) -> Column:
    """Whether the box starts in the top or ends in the bottom twentieth of the page."""
    return (b.ymin < 0.05 * height) | (b.ymax > 0.95 * height)


def resized(width: Column, height: Column, longest: int = 1600) -> list[Column]:
    """Width and height with the longer side at most ``longest``, aspect kept, truncated."""
    most = F.greatest(width, height)
    ratio = F.when(most > longest, F.lit(float(longest)) / most).otherwise(F.lit(1.0))
    return [(width * ratio).cast("int"), (height * ratio).cast("int")]


def overlay_color(kind: Column, quality: Column, overlaps: Column) -> Column:
    """Colour of an element's frame."""
    base = F.when(kind == "HEADER", "blue").when(kind == "TABLE", "green").when(kind.isin("FIGURE", "CHART"), "orange").when(kind == "FOOTER", "gray").otherwise("black")
    return F.when((quality > 0) & (quality < 0.5), "darkred").when(overlaps, "purple").otherwise(base)
