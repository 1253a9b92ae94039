"""Geometry as column expressions.

A polygon is either a list of (x, y) numbers, which becomes part of the
expression, or an array<struct<x,y>> column, which is walked with higher-order
functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import let

Polygon = Sequence[tuple[float, float]] | Column
#: A cone reaches this far from its apex.
CONE_LENGTH = 10000.0


def _lit(v: float) -> Column:
    return F.lit(float(v))


def _crosses(x: Column, y: Column, xi: Column, yi: Column, xj: Column, yj: Column) -> Column:
    rise = F.when(yj == yi, F.lit(1e-12)).otherwise(yj - yi)
    return ((yi > y) != (yj > y)) & (x < (xj - xi) * (y - yi) / rise + xi)


def edges(poly: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(x, y, next x, next y) of each edge."""
    return [(*poly[k], *poly[(k + 1) % len(poly)]) for k in range(len(poly))]


def edge_array(poly: Column) -> Column:
    """array<struct<ax,ay,bx,by>> of a polygon column."""
    n = F.size(poly)

    def edge(p: Column, k: Column) -> Column:
        after = F.get(poly, (k + 1) % n)
        return F.struct(p["x"].alias("ax"), p["y"].alias("ay"), after["x"].alias("bx"), after["y"].alias("by"))

    return F.transform(poly, edge)


def point_in_polygon(x: Column, y: Column, poly: Polygon) -> Column:
    """Ray cast, half open; fewer than three vertices hold nothing."""
    if isinstance(poly, Column):
        hits = F.filter(edge_array(poly), lambda e: _crosses(x, y, e["bx"], e["by"], e["ax"], e["ay"]))
        return (F.size(poly) >= 3) & (F.size(hits) % 2 == 1)
    if len(poly) < 3:
        return F.lit(False)
    n = sum((_crosses(x, y, *(_lit(v) for v in (bx, by, ax, ay))).cast("int") for ax, ay, bx, by in edges(poly)), F.lit(0))
    return n % 2 == 1


def _closest(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / length)))
    return ax + t * dx, ay + t * dy


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    cx, cy = _closest(x, y, ax, ay, bx, by)
    return F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))


def boundary_distance(x: Column, y: Column, poly: Polygon) -> Column:
    """Distance to the nearest point of a polygon's outline."""
    if isinstance(poly, Column):
        return F.array_min(F.transform(edge_array(poly), lambda e: segment_distance(x, y, e["ax"], e["ay"], e["bx"], e["by"])))
    return F.least(*(segment_distance(x, y, *(_lit(v) for v in e)) for e in edges(poly)))


def nearest_on_boundary(x: Column, y: Column, poly: Sequence[tuple[float, float]]) -> Column:
    """struct<x,y>: the nearest point of an outline (of equally near edges the first)."""
    found = []
    for k, e in enumerate(edges(poly)):
        cx, cy = _closest(x, y, *(_lit(v) for v in e))
        found.append(F.struct(((x - cx) * (x - cx) + (y - cy) * (y - cy)).alias("d"), F.lit(k).alias("k"), cx.alias("x"), cy.alias("y")))
    best = F.array_min(F.array(*found))
    return F.struct(best["x"].alias("x"), best["y"].alias("y"))


def _lengths(poly: Sequence[tuple[float, float]]) -> list[float]:
    return [math.hypot(bx - ax, by - ay) for ax, ay, bx, by in edges(poly)]


def outline_length(poly: Sequence[tuple[float, float]]) -> float:
    return sum(_lengths(poly))


def centroid(poly: Sequence[tuple[float, float]]) -> tuple[float, float]:
    """Centre of a polygon's area."""
    parts = [(ax * by - bx * ay, ax + bx, ay + by) for ax, ay, bx, by in edges(poly)]
    area = 3 * sum(c for c, _, _ in parts)
    return sum(c * x for c, x, _ in parts) / area, sum(c * y for c, _, y in parts) / area


def along_boundary(x: Column, y: Column, poly: Sequence[tuple[float, float]]) -> Column:
    """struct<x,y,s>: the nearest point of an outline (of equally near edges the first) and its distance from the first corner along the outline."""
    found, before = [], 0.0
    for k, (e, n) in enumerate(zip(edges(poly), _lengths(poly), strict=True)):
        cx, cy = _closest(x, y, *(_lit(v) for v in e))
        s = F.lit(before) + F.sqrt((cx - _lit(e[0])) * (cx - _lit(e[0])) + (cy - _lit(e[1])) * (cy - _lit(e[1])))
        found.append(F.struct(((x - cx) * (x - cx) + (y - cy) * (y - cy)).alias("d"), F.lit(k).alias("k"), cx.alias("x"), cy.alias("y"), s.alias("s")))
        before += n
    best = F.array_min(F.array(*found))
    return F.struct(best["x"].alias("x"), best["y"].alias("y"), best["s"].alias("s"))


def on_outline(x: float, y: float, poly: Sequence[tuple[float, float]]) -> tuple[float, float, float]:
    """`along_boundary` of one known point."""
    found, before = [], 0.0
    for k, ((ax, ay, bx, by), n) in enumerate(zip(edges(poly), _lengths(poly), strict=True)):
        t = min(1.0, max(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / (n * n))) if n else 0.0
        cx, cy = ax + t * (bx - ax), ay + t * (by - ay)
        found.append(((x - cx) ** 2 + (y - cy) ** 2, k, cx, cy, before + t * n))
        before += n
    return min(found)[2:]


def snap_into(x: Column, y: Column, boundary: Sequence[tuple[float, float]], entries: Sequence[Sequence[tuple[float, float]]] = ()) -> Column:
    """The point itself inside the boundary or an entry polygon, else the nearest point of the boundary."""
    inside = point_in_polygon(x, y, boundary)
    for poly in entries:
        inside = inside | point_in_polygon(x, y, poly)
    return F.when(inside, F.struct(x.alias("x"), y.alias("y"))).otherwise(nearest_on_boundary(x, y, boundary))


def scaled(poly: Sequence[tuple[float, float]], factor: float) -> list[tuple[float, float]]:
    """A polygon scaled about the centre of its bounding box."""
    xs, ys = [p[0] for p in poly], [p[1] for p in poly]
    cx, cy = (min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2
    return [(cx + (x - cx) * factor, cy + (y - cy) * factor) for x, y in poly]


def birth_location(x: Column, y: Column, boundary: Sequence[tuple[float, float]], entries: Sequence[Sequence[tuple[float, float]]], buffer: float = 1.15, pad: float = 0.0) -> Column:
    """unknown, entry, entry_buffer, interior, boundary_band or outside."""

    def any_of(polys: Sequence[Sequence[tuple[float, float]]]) -> Column:
        out = F.lit(False)
        for p in polys:
            out = out | point_in_polygon(x, y, p)
        return out

    known = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    out = F.when(~known, "unknown").when(any_of(entries), "entry").when(any_of([scaled(p, buffer) for p in entries]), "entry_buffer").when(point_in_polygon(x, y, boundary), "interior")
    if pad > 0:
        out = out.when(point_in_polygon(x, y, scaled(boundary, 1 + pad)), "boundary_band")
    return out.otherwise("outside")


def project(x: Column, y: Column, h: Column | Sequence[float]) -> Column:
    """struct<x,y>: a homography of nine numbers applied to a point; NaN where it has no image."""
    m = [F.get(h, F.lit(k)) for k in range(9)] if isinstance(h, Column) else [_lit(v) for v in h]
    w = m[6] * x + m[7] * y + m[8]

    def coordinate(a: Column, b: Column, c: Column) -> Column:
        v = F.when(w != 0, (a * x + b * y + c) / w)
        return F.coalesce(v, F.lit(float("nan")))

    return F.struct(coordinate(m[0], m[1], m[2]).alias("x"), coordinate(m[3], m[4], m[5]).alias("y"))


def invert(h: Sequence[float]) -> list[float]:
    """The inverse of a homography."""
    a, b, c, d, e, f, g, k, i = h
    adj = [e * i - f * k, c * k - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * k - e * g, b * g - a * k, a * e - b * d]
    det = a * adj[0] + b * adj[3] + c * adj[6]
    return [v / det for v in adj]


def box_bottom(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(((x1 + x2) / 2).alias("x"), y2.alias("y"))


def xyxy_to_xywh(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column, Column]:
    return (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    return x - w / 2, y - h / 2, x + w / 2, y + h / 2


def xyxy_to_tlwh(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column, Column]:
    return x1, y1, x2 - x1, y2 - y1


def tlwh_to_xyah(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    """Centre, aspect ratio (width / height) and height."""
    return x + w / 2, y + h / 2, w / h, h


def xyxy_to_xysr(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column, Column]:
    """Centre, area and aspect ratio."""
    w, h = x2 - x1, y2 - y1
    return x1 + w / 2, y1 + h / 2, w * h, w / (h + F.lit(1e-6))


def boxes_touch(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Whether two boxes (x1, y1, x2, y2) overlap or touch."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def cone(ox: Column, oy: Column, dx: Column, dy: Column, half_angle: float, length: float = CONE_LENGTH) -> tuple[Column, ...]:
    """The six coordinates of a gaze triangle; all zero for a direction of no length."""
    n = F.sqrt(dx * dx + dy * dy)
    c, s = math.cos(math.radians(half_angle)), math.sin(math.radians(half_angle))
    ux, uy = dx / n, dy / n
    points = (ox, oy, ox + (c * ux - s * uy) * length, oy + (s * ux + c * uy) * length, ox + (c * ux + s * uy) * length, oy + (c * uy - s * ux) * length)
    return tuple(F.when(n == 0, F.lit(0.0)).otherwise(p) for p in points)


def triangle_meets_box(t: Sequence[Column], box: Sequence[Column]) -> Column:
    """Whether a triangle and a box share area: open projections overlap on all five axes."""
    tx, ty = t[0::2], t[1::2]
    bx, by = (box[0], box[2], box[2], box[0]), (box[1], box[1], box[3], box[3])
    out = (F.least(*tx) < box[2]) & (F.greatest(*tx) > box[0]) & (F.least(*ty) < box[3]) & (F.greatest(*ty) > box[1])
    for k in range(3):
        nx, ny = ty[k] - ty[(k + 1) % 3], tx[(k + 1) % 3] - tx[k]
        p = [nx * a + ny * b for a, b in zip(tx, ty, strict=True)]
        q = [nx * a + ny * b for a, b in zip(bx, by, strict=True)]
        out = out & (F.least(*p) < F.greatest(*q)) & (F.least(*q) < F.greatest(*p))
    return out & (box[2] > box[0]) & (box[3] > box[1])


def wall_polygon(corners: Column, fraction: float = 0.2) -> Column:
    """Inner polygon of a room whose corners are top left, top right, bottom right, bottom left.

    Each corner moves inwards by a fraction of its two sides (top or bottom along
    x, left or right along y) and is cut to whole numbers.
    """
    x, y = (lambda k: F.get(corners, F.lit(k))["x"]), (lambda k: F.get(corners, F.lit(k))["y"])
    top, bottom = F.abs(x(0) - x(1)) * fraction, F.abs(x(2) - x(3)) * fraction
    left, right = F.abs(y(0) - y(3)) * fraction, F.abs(y(1) - y(2)) * fraction
    moved = [(x(0) + top, y(0) + left), (x(1) - top, y(1) + right), (x(2) - bottom, y(2) - right), (x(3) + bottom, y(3) - left)]
    return F.array(*[F.struct(a.cast("int").alias("x"), b.cast("int").alias("y")) for a, b in moved])


def _points() -> Column:
    return F.array().cast("array<struct<x:double,y:double>>")


def polygon_area(poly: Column) -> Column:
    """Signed area (counter-clockwise is positive) of a polygon column; 0 for fewer than three points."""
    return let(poly, lambda p: F.aggregate(edge_array(p), F.lit(0.0), lambda a, e: a + (e["ax"] * e["by"] - e["bx"] * e["ay"])) / 2)


def clipped(poly: Column, window: Column) -> Column:
    """The part of a convex polygon inside a convex one that is counter-clockwise, as a fold over the window's edges."""

    def cut(points: Column, e: Column) -> Column:
        side = lambda x, y: (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])

        def kept(q: Column) -> Column:
            s, t = side(q["ax"], q["ay"]), side(q["bx"], q["by"])
            share = s / (s - t)
            here = F.struct(q["ax"].alias("x"), q["ay"].alias("y"))
            there = F.struct((q["ax"] + share * (q["bx"] - q["ax"])).alias("x"), (q["ay"] + share * (q["by"] - q["ay"])).alias("y"))
            return F.concat(F.when(s >= 0, F.array(here)).otherwise(_points()), F.when((s >= 0) != (t >= 0), F.array(there)).otherwise(_points()))

        return F.flatten(F.transform(edge_array(points), kept))

    return F.aggregate(edge_array(window), poly, cut)


def circle(x: Column, y: Column, radius: float, sides: int = 64) -> Column:
    """A regular polygon of `sides` points on a circle."""
    turns = F.array(*[F.struct(F.lit(radius * math.cos(2 * math.pi * k / sides)).alias("x"), F.lit(radius * math.sin(2 * math.pi * k / sides)).alias("y")) for k in range(sides)])
    return F.transform(turns, lambda p: F.struct((x + p["x"]).alias("x"), (y + p["y"]).alias("y")))


def circle_share(quad: Column, x: Column, y: Column, radius: float, sides: int = 64) -> Column:
    """Share of a circle (as a polygon of `sides`) that a convex quadrilateral column covers."""
    low, high = (lambda c: F.array_min(F.transform(quad, lambda p: p[c]))), (lambda c: F.array_max(F.transform(quad, lambda p: p[c])))
    apart = (low("x") > x + radius) | (high("x") < x - radius) | (low("y") > y + radius) | (high("y") < y - radius)
    window = F.when(polygon_area(quad) >= 0, quad).otherwise(F.reverse(quad))
    whole = sides * radius * radius * math.sin(2 * math.pi / sides) / 2
    return F.when(apart, 0.0).otherwise(let(window, lambda w: polygon_area(clipped(circle(x, y, radius, sides), w)) / whole))


def circle_shares(quads: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float, sides: int = 64, block: int = 1024) -> np.ndarray:
    """`circle_share` of rows of quads (n, 4, 2), compiled: half the sum of the cross products along the outline of the common area.

    That outline is what of the circle's edges lies in the quad and what of the quad's edges lies strictly in the circle.
    """
    turns = 2 * np.pi * np.arange(sides) / sides
    v = radius * np.stack([np.cos(turns), np.sin(turns)], 1)
    e = np.roll(v, -1, 0) - v
    out = np.zeros(len(quads))

    def inner(s: np.ndarray, t: np.ndarray, out_of: np.ndarray, axis: int) -> np.ndarray:
        """The share of each edge between its sides of all half-planes: s at its start, t at its end."""
        with np.errstate(divide="ignore", invalid="ignore"):
            cut = s / (s - t)
        first = np.where((s < 0) & (t >= 0), cut, 0.0).max(axis)
        last = np.where((s >= 0) & (t < 0), cut, 1.0).min(axis)
        return np.where(out_of.any(axis), 0.0, np.maximum(last - first, 0.0))

    for k in range(0, len(quads), block):
        q = quads[k : k + block] - np.stack([x[k : k + block], y[k : k + block]], 1)[:, None]
        area = (q[:, :, 0] * np.roll(q[:, :, 1], -1, 1) - np.roll(q[:, :, 0], -1, 1) * q[:, :, 1]).sum(1)
        q = np.where((area >= 0)[:, None, None], q, q[:, ::-1])
        after = np.roll(q, -1, 1)
        d = after - q
        s = d[:, :, None, 0] * (v[:, 1] - q[:, :, None, 1]) - d[:, :, None, 1] * (v[:, 0] - q[:, :, None, 0])  # row, edge of the quad, corner of the circle
        t = np.roll(s, -1, 2)
        total = (inner(s, t, (s < 0) & (t < 0), 1) * (v[:, 0] * e[:, 1] - v[:, 1] * e[:, 0])).sum(1)
        s = e[:, 0] * (q[:, :, None, 1] - v[:, 1]) - e[:, 1] * (q[:, :, None, 0] - v[:, 0])  # row, corner of the quad, edge of the circle
        t = np.roll(s, -1, 1)
        out[k : k + block] = total + (inner(s, t, (s <= 0) & (t <= 0), 2) * (q[:, :, 0] * after[:, :, 1] - q[:, :, 1] * after[:, :, 0])).sum(1)
    return out / (sides * radius * radius * np.sin(2 * np.pi / sides))


def strictly_inside(x: Column, y: Column, quad: Column) -> Column:
    """Whether a point is inside a convex polygon column, its outline left out."""
    turns = F.transform(edge_array(quad), lambda e: (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"]))
    return F.forall(turns, lambda t: t > 0) | F.forall(turns, lambda t: t < 0)


def column_centroid(poly: Column) -> Column:
    """struct<x,y>: centre of the area of a polygon column."""
    zero = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(a: Column, e: Column) -> Column:
        c = e["ax"] * e["by"] - e["bx"] * e["ay"]
        return F.struct((a["c"] + c).alias("c"), (a["x"] + c * (e["ax"] + e["bx"])).alias("x"), (a["y"] + c * (e["ay"] + e["by"])).alias("y"))

    return F.aggregate(edge_array(poly), zero, add, lambda a: F.struct((a["x"] / (3 * a["c"])).alias("x"), (a["y"] / (3 * a["c"])).alias("y")))


def place_from_walls(cx: Column, cy: Column, ua: Sequence[Column], ub: Sequence[Column], from_a: Column, from_b: Column, scale: Column, least_degrees: float = 5.0) -> Column:
    """struct<x,y>: the point at given distances from two walls that meet in a corner.

    `ua` and `ub` are unit directions of the walls.  The point is corner + s ua + t ub
    where its distance to wall A is |t| |sin| and to wall B |s| |sin|; null for
    walls that are nearly parallel.
    """
    cross = ua[0] * ub[1] - ua[1] * ub[0]
    sine = F.abs(cross)
    t, s = from_a * scale / sine, from_b * scale / sine
    ok = sine >= math.sin(math.radians(least_degrees))
    return F.when(ok, F.struct((cx + s * ua[0] + t * ub[0]).alias("x"), (cy + s * ua[1] + t * ub[1]).alias("y")))
