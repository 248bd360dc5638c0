"""Geometry as column expressions: boxes are structs (xmin, ymin, xmax, ymax), points are columns x and y.

Products are written out instead of powers, so that results are the same doubles in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of the Hilbert key, two bits each.
HILBERT_LEVELS = 26


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.struct(xmin.alias("xmin"), ymin.alias("ymin"), xmax.alias("xmax"), ymax.alias("ymax"))


def point_box(x: Column, y: Column) -> Column:
    return box(x, y, x, y)


def width(r: Column) -> Column:
    return r["xmax"] - r["xmin"]


def height(r: Column) -> Column:
    return r["ymax"] - r["ymin"]


def rect_area(r: Column) -> Column:
    return width(r) * height(r)


def rect_margin(r: Column) -> Column:
    """The perimeter."""
    return F.lit(2.0) * (width(r) + height(r))


def rect_intersects(a: Column, b: Column) -> Column:
    """Closed boxes: touching counts."""
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def rect_contains(r: Column, x: Column, y: Column) -> Column:
    return x.between(r["xmin"], r["xmax"]) & y.between(r["ymin"], r["ymax"])


def rect_intersection_area(a: Column, b: Column) -> Column:
    w = F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"])
    h = F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def rect_union_area(a: Column, b: Column) -> Column:
    """Area covered by either box."""
    return rect_area(a) + rect_area(b) - rect_intersection_area(a, b)


def mbr_enlarge(r: Column, other: Column) -> Column:
    """The least box around both."""
    return box(F.least(r["xmin"], other["xmin"]), F.least(r["ymin"], other["ymin"]), F.greatest(r["xmax"], other["xmax"]), F.greatest(r["ymax"], other["ymax"]))


def rect_enlargement(r: Column, other: Column) -> Column:
    """Area that r grows by to hold the other box."""
    return rect_area(mbr_enlarge(r, other)) - rect_area(r)


def distance(x: Column, y: Column, qx: Column, qy: Column) -> Column:
    dx, dy = x - qx, y - qy
    return F.sqrt(dx * dx + dy * dy)


def point_rect_mindist(qx: Column, qy: Column, r: Column) -> Column:
    dx = F.greatest(r["xmin"] - qx, F.lit(0.0), qx - r["xmax"])
    dy = F.greatest(r["ymin"] - qy, F.lit(0.0), qy - r["ymax"])
    return F.sqrt(dx * dx + dy * dy)


def vector_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of arrays of doubles."""
    squares = F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def vector_in_box(v: Column, lo: Column, hi: Column) -> Column:
    """Closed containment in every dimension."""
    return F.forall(F.arrays_zip(v.alias("v"), lo.alias("lo"), hi.alias("hi")), lambda z: (z["lo"] <= z["v"]) & (z["v"] <= z["hi"]))


def dominates(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """a is no larger than b in both coordinates and smaller in one."""
    return (ax <= bx) & (ay <= by) & ((ax < bx) | (ay < by))


def mbr(x: Column, y: Column) -> list[Column]:
    """Aggregates that make the least box around points."""
    return [F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax")]


def mbr_of(r: Column) -> list[Column]:
    """Aggregates that make the least box around boxes."""
    return [F.min(r["xmin"]).alias("xmin"), F.min(r["ymin"]).alias("ymin"), F.max(r["xmax"]).alias("xmax"), F.max(r["ymax"]).alias("ymax")]


def as_box(prefix: str = "") -> Column:
    """Columns xmin, ymin, xmax, ymax as a box."""
    return box(*(F.col(prefix + c) for c in ("xmin", "ymin", "xmax", "ymax")))


def hilbert_key(x: Column, y: Column, side: Column, levels: int = HILBERT_LEVELS) -> Column:
    """Place of a point of the square [0, side] on the Hilbert curve, two bits a level.

    A coordinate on a middle line belongs to the lower half. Deeper cells tie; callers add a key to the order.
    """

    def step(s: Column, _: Column) -> Column:
        half = s["side"] / 2
        right, up = s["x"] > half, s["y"] > half
        turn = F.when(right & up, 2).when(right, 3).when(up, 1).otherwise(0).cast("long")
        # The first quarter is mirrored, the last one mirrored on the other diagonal.
        nx = F.when(right & up, s["x"] - half).when(right, half - s["y"]).when(up, s["x"]).otherwise(s["y"])
        ny = F.when(right & up, s["y"] - half).when(right, s["side"] - s["x"]).when(up, s["y"] - half).otherwise(s["x"])
        return F.struct(nx.alias("x"), ny.alias("y"), half.alias("side"), (s["h"] * 4 + turn).alias("h"))

    start = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), side.cast("double").alias("side"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, step)["h"]
