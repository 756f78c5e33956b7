"""Rectangles, points and view transforms as column expressions. A rectangle has x, y, w and h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def overlaps(a: Column, b: Column) -> Column:
    """Strictly: touching edges don't overlap."""
    return (a["x"] < b["x"] + b["w"]) & (b["x"] < a["x"] + a["w"]) & (a["y"] < b["y"] + b["h"]) & (b["y"] < a["y"] + a["h"])


def meets(a: Column, b: Column) -> Column:
    """Edges included."""
    return (a["x"] <= b["x"] + b["w"]) & (b["x"] <= a["x"] + a["w"]) & (a["y"] <= b["y"] + b["h"]) & (b["y"] <= a["y"] + a["h"])


def contains(r: Column, x: Column, y: Column) -> Column:
    return (x >= r["x"]) & (x <= r["x"] + r["w"]) & (y >= r["y"]) & (y <= r["y"] + r["h"])


def union(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return rect(x, y, F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x, F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y)


def clamped(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(value, high))


def translated(r: Column, dx: Column, dy: Column, page: Column) -> Column:
    """r moved, but not off the page."""
    return rect(clamped(r["x"] + dx, page["x"], page["x"] + page["w"] - r["w"]), clamped(r["y"] + dy, page["y"], page["y"] + page["h"] - r["h"]), r["w"], r["h"])


def resized(r: Column, handle: Column, dx: Column, dy: Column, page: Column, least: float) -> Column:
    """r with the corner or edge named by handle (n, s, e, w or two of them) moved, on the page, no side under least."""
    left, right, low, high = r["x"], r["x"] + r["w"], r["y"], r["y"] + r["h"]
    size = F.lit(float(least))
    left = F.when(F.contains(handle, F.lit("w")), clamped(left + dx, page["x"], right - size)).otherwise(left)
    right = F.when(F.contains(handle, F.lit("e")), clamped(right + dx, r["x"] + size, page["x"] + page["w"])).otherwise(right)
    low = F.when(F.contains(handle, F.lit("s")), clamped(low + dy, page["y"], high - size)).otherwise(low)
    high = F.when(F.contains(handle, F.lit("n")), clamped(high + dy, r["y"] + size, page["y"] + page["h"])).otherwise(high)
    return rect(left, low, right - left, high - low)


def handle_at(r: Column, x: Column, y: Column, size: float) -> Column:
    """The handle under a point: corners first, then edges; null for none."""
    half = size / 2
    near = lambda a, b: F.abs(a - b) <= half
    left, right, low, high = r["x"], r["x"] + r["w"], r["y"], r["y"] + r["h"]
    mid_x, mid_y = r["x"] + r["w"] / 2, r["y"] + r["h"] / 2
    spots = (("nw", left, high), ("ne", right, high), ("sw", left, low), ("se", right, low), ("n", mid_x, high), ("s", mid_x, low), ("w", left, mid_y), ("e", right, mid_y))
    return F.coalesce(*(F.when(near(x, px) & near(y, py), F.lit(name)) for name, px, py in spots))


def from_unit_square(r: Column, page: Column) -> Column:
    """A box of unit coordinates on the page."""
    return rect(r["x"] * page["w"] + page["x"], r["y"] * page["h"] + page["y"], r["w"] * page["w"], r["h"] * page["h"])


def dragged(x0: Column, y0: Column, x1: Column, y1: Column, least: float = 5.0) -> Column:
    """The rectangle between two points; null if either side is under least."""
    w, h = F.abs(x1 - x0), F.abs(y1 - y0)
    return F.when((w >= least) & (h >= least), rect(F.least(x0, x1), F.least(y0, y1), w, h))


def ink_box(points: Column, pad: float = 5.0) -> Column:
    """The box around points (an array of x, y), padded."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return rect(F.array_min(xs) - pad, F.array_min(ys) - pad, F.array_max(xs) - F.array_min(xs) + 2 * pad, F.array_max(ys) - F.array_min(ys) + 2 * pad)


#: Bounds of the scale of a view, and a step of zooming.
LEAST_ZOOM, MOST_ZOOM, ZOOM_STEP = 0.1, 5.0, 1.2


def zoomed(scale: Column, factor: Column) -> Column:
    return clamped(scale * factor, F.lit(LEAST_ZOOM), F.lit(MOST_ZOOM))


def zoomed_offset(offset: Column, cursor: Column, old: Column, new: Column) -> Column:
    """The offset of an axis that keeps what is under the cursor in place."""
    return cursor - (cursor - offset) * new / old


# Where on the canvas each level's band is, and node sizes.
BANDS = {"document": 0.15, "chapter": 0.40, "concept": 0.65, "entity": 0.85}
SIZES = {"document": (200.0, 60.0), "chapter": (180.0, 50.0), "concept": (140.0, 40.0), "entity": (100.0, 30.0)}


def band_y(level: Column, height: Column) -> Column:
    share = F.lit(None).cast("double")
    for name, value in BANDS.items():
        share = F.when(level == name, F.lit(value)).otherwise(share)
    return share * height


def node_size(level: Column, has_summary: Column, more: float = 20.0) -> Column:
    """w and h of a node; a summary makes it higher."""
    w = h = F.lit(None).cast("double")
    for name, (a, b) in SIZES.items():
        w, h = F.when(level == name, F.lit(a)).otherwise(w), F.when(level == name, F.lit(b)).otherwise(h)
    return F.struct(w.alias("w"), (h + F.when(has_summary, F.lit(more)).otherwise(0.0)).alias("h"))
