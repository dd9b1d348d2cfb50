"""Box and interval arithmetic as column expressions; boxes are (x0, y0, x1, y1), y grows downward."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over hull of two intervals; 0 if they only touch or are apart."""
    part = (F.least(a1, b1) - F.greatest(a0, b0)) / (F.greatest(a1, b1) - F.least(a0, b0))
    return F.when((b0 >= a1) | (a0 >= b1), F.lit(0.0)).otherwise(part)


def interval_iou_unguarded(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Middle part over hull, without a test for disjoint intervals: their gap counts."""
    s = F.array_sort(F.array(a0, a1, b0, b1))
    return (s[2] - s[1]) / F.nullif(s[3] - s[0], F.lit(0.0))


def axis_iou(a: str, b: str, axis: str) -> Column:
    """IoU along 'x' or 'y' of the boxes whose columns carry the prefixes a and b."""
    c = F.col
    return interval_iou(c(f"{a}{axis}0"), c(f"{a}{axis}1"), c(f"{b}{axis}0"), c(f"{b}{axis}1"))


def containment(a: str, b: str) -> Column:
    """Share of box a that lies in box b; 0 if they only touch, null for an a without area."""
    c = F.col
    w = F.least(c(f"{a}x1"), c(f"{b}x1")) - F.greatest(c(f"{a}x0"), c(f"{b}x0"))
    h = F.least(c(f"{a}y1"), c(f"{b}y1")) - F.greatest(c(f"{a}y0"), c(f"{b}y0"))
    area = (c(f"{a}x1") - c(f"{a}x0")) * (c(f"{a}y1") - c(f"{a}y0"))
    return F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise(w * h / F.nullif(area, F.lit(0.0)))


def rule_distance(c1: Column, a0: Column, a1: Column, c2: Column, b0: Column, b1: Column) -> Column:
    """Twice the offset of two parallel rules, or the gap between their extents if that is larger."""
    gap = F.greatest(a0, b0) - F.least(a1, b1)
    return F.greatest(2 * F.abs(c1 - c2), F.greatest(gap, F.lit(0)))


def centred(x0: Column, x1: Column, m0: Column, m1: Column, slack: float = 4.0) -> Column:
    """Whether both insets from a margin pair exceed the slack and agree within it."""
    left, right = x0 - m0, m1 - x1
    return (left > slack) & (right > slack) & (F.abs(left - right) < slack)
