"""Rectangle predicates; all edges belong to the rectangle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rect:
    """Four columns that describe a rectangle."""

    def __init__(self, x: Column, y: Column, width: Column, height: Column):
        self.x, self.y, self.width, self.height = x, y, width, height

    @classmethod
    def named(cls, prefix: str = "") -> "Rect":
        return cls(*(F.col(prefix + name) for name in ("x", "y", "width", "height")))

    @classmethod
    def literal(cls, x: float, y: float, width: float, height: float) -> "Rect":
        return cls(*(F.lit(float(value)) for value in (x, y, width, height)))

    @property
    def right(self) -> Column:
        return self.x + self.width

    @property
    def bottom(self) -> Column:
        return self.y + self.height


def rect_contains(rect: Rect, x: Column, y: Column) -> Column:
    return x.between(rect.x, rect.right) & y.between(rect.y, rect.bottom)


def rects_intersect(a: Rect, b: Rect) -> Column:
    return (b.x <= a.right) & (b.right >= a.x) & (b.y <= a.bottom) & (b.bottom >= a.y)
