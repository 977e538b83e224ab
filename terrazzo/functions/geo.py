"""Plane and earth geometry as column expressions.

A point is struct(x, y) and a ring an array of points without a repeated end; points on the earth are
(lat, lng) in degrees. All stays in the JVM but for M12, M14 and M20, which are Arrow functions.
"""

from __future__ import annotations

import math

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_R = 6371008.8
MERCATOR = 20037508.342789244
POINT = "struct<x:double,y:double>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def half_up(v: Column, digits: int) -> Column:
    """Rounded, halves toward plus infinity."""
    f = 10**digits
    return F.floor(v * f + 0.5).cast("double") / f


def dist(a: Column, b: Column) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Meters."""
    s, t = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lng2 - lng1) / 2)
    a = s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * t * t
    return F.lit(2 * EARTH_R) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def meters_per_degree(lat: Column) -> tuple[Column, Column]:
    """Of latitude and of longitude, by the WGS84 series."""
    p = F.radians(lat)
    return (
        111132.92 - 559.82 * F.cos(2 * p) + 1.175 * F.cos(4 * p) - 0.0023 * F.cos(6 * p),
        111412.84 * F.cos(p) - 93.5 * F.cos(3 * p) + 0.118 * F.cos(5 * p),
    )


def local_xy(lat: Column, lng: Column, lat0: Column, lng0: Column) -> Column:
    """East and north meters from a center."""
    m_lat, m_lng = meters_per_degree(lat0)
    return point((lng - lng0) * m_lng, (lat - lat0) * m_lat)


def local_lat_lng(p: Column, lat0: Column, lng0: Column) -> Column:
    """M02's inverse, as struct(x: lng, y: lat)."""
    m_lat, m_lng = meters_per_degree(lat0)
    return point(lng0 + p["x"] / m_lng, lat0 + p["y"] / m_lat)


def tile(lat: Column, lng: Column, zoom: int) -> tuple[Column, Column]:
    """Web Mercator tile numbers."""
    n, r = 2**zoom, F.radians(lat)
    return F.floor((lng + 180) / 360 * n), F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n)


def tile_bounds(x: Column, y: Column, zoom: int) -> Column:
    """West, south, east, north in degrees."""
    n = 2**zoom
    lng = lambda v: v / n * 360 - 180
    lat = lambda v: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * v / n))))
    return F.struct(lng(x).alias("west"), lat(y + 1).alias("south"), lng(x + 1).alias("east"), lat(y).alias("north"))


def rotated(ring: Column) -> Column:
    """Each point's successor."""
    return F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def signed_area(ring: Column) -> Column:
    """Shoelace; positive if counter-clockwise with y up."""
    return _total(F.zip_with(ring, rotated(ring), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring: Column) -> Column:
    """Of the area, or the mean of the points if there is none."""
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    a = signed_area(ring) * 2
    cx = _total(F.zip_with(ring, rotated(ring), lambda p, q: (p["x"] + q["x"]) * cross(p, q)))
    cy = _total(F.zip_with(ring, rotated(ring), lambda p, q: (p["y"] + q["y"]) * cross(p, q)))
    mean = point(_total(F.transform(ring, lambda p: p["x"])) / F.size(ring), _total(F.transform(ring, lambda p: p["y"])) / F.size(ring))
    return F.when(F.abs(a) < 1e-12, mean).otherwise(point(cx / (3 * a), cy / (3 * a)))


def in_ring(p: Column, ring: Column) -> Column:
    """Even-odd rule; the boundary is undefined."""

    def crosses(a: Column, b: Column) -> Column:
        x = (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return F.when(((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < x), 1).otherwise(0)

    return F.aggregate(F.zip_with(ring, rotated(ring), crosses), F.lit(0), lambda s, c: s + c) % 2 == 1


def closest_on_segment(p: Column, a: Column, b: Column) -> Column:
    """struct(x, y, t): the nearest point and its place from 0 to 1."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / n))).otherwise(0.0)
    return F.struct((a["x"] + t * dx).alias("x"), (a["y"] + t * dy).alias("y"), t.alias("t"))


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    return dist(p, closest_on_segment(p, a, b))


def ring_distance(p: Column, ring: Column, closed: bool = True) -> Column:
    """To the nearest side; without `closed` the last point doesn't join the first."""
    near = F.zip_with(ring, rotated(ring), lambda a, b: segment_distance(p, a, b))
    return F.array_min(near if closed else F.slice(near, 1, F.greatest(F.size(ring) - 1, F.lit(1))))


def signed_ring_distance(p: Column, ring: Column) -> Column:
    """Negative outside."""
    return F.when(in_ring(p, ring), 1).otherwise(-1) * ring_distance(p, ring)


def sample_ring(ring: Column, step: float) -> Column:
    """Points at most `step` apart along a closed ring, its own included."""

    def side(a: Column, b: Column) -> Column:
        k = F.greatest(F.lit(1), F.ceil(dist(a, b) / step)).cast("int")
        return F.transform(F.sequence(F.lit(0), k - 1), lambda j: point(a["x"] + (b["x"] - a["x"]) * j / k, a["y"] + (b["y"] - a["y"]) * j / k))

    return F.flatten(F.zip_with(ring, rotated(ring), side))


def segments_intersect(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The segments cross or touch."""
    turn = lambda p, q, r: F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))
    on = lambda p, q, r: (turn(p, q, r) == 0) & r["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & r["y"].between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))
    proper = (turn(a, b, c) != turn(a, b, d)) & (turn(c, d, a) != turn(c, d, b)) & (turn(a, b, c) * turn(a, b, d) <= 0) & (turn(c, d, a) * turn(c, d, b) <= 0)
    return proper | on(a, b, c) | on(a, b, d) | on(c, d, a) | on(c, d, b)


def arc_points(center: Column, r: Column, a0: Column, a1: Column, step_degrees: float = 10.0) -> Column:
    """Points of an arc from angle a0 to a1 in radians, both ends included."""
    k = F.greatest(F.lit(1), F.ceil(F.abs(a1 - a0) / math.radians(step_degrees))).cast("int")
    at = lambda j: a0 + (a1 - a0) * j / k
    return F.transform(F.sequence(F.lit(0), k), lambda j: point(center["x"] + r * F.cos(at(j)), center["y"] + r * F.sin(at(j))))


def bulge_arc(a: Column, b: Column, bulge: Column, step_degrees: float = 10.0) -> Column:
    """The side a-b as the points of its arc, of which the bulge is the tangent of a quarter angle; 0 is straight."""
    half = dist(a, b) / 2
    r = half * (1 + bulge * bulge) / (2 * F.abs(bulge))
    off = half * (1 - bulge * bulge) / (2 * bulge)
    mx, my = (a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2
    c = point(mx - off * (b["y"] - a["y"]) / (2 * half), my + off * (b["x"] - a["x"]) / (2 * half))
    start = F.atan2(a["y"] - c["y"], a["x"] - c["x"])
    arc = arc_points(c, r, start, start + 4 * F.atan(bulge), step_degrees)
    return F.when((bulge == 0) | (half == 0), F.array(a, b)).otherwise(arc)


def clean_ring(ring: Column, tolerance: float) -> Column:
    """Without points within tolerance of the kept one before, nor a last one within it of the first."""
    none = F.array().cast(f"array<{POINT}>")
    kept = F.aggregate(ring, none, lambda s, p: F.when((F.size(s) > 0) & (dist(F.try_element_at(s, F.lit(-1)), p) <= tolerance), s).otherwise(F.array_append(s, p)))
    return F.when((F.size(kept) > 1) & (dist(F.try_element_at(kept, F.lit(-1)), F.get(kept, F.lit(0))) <= tolerance), F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)


def insert_transform(p: Column, sx: Column, sy: Column, degrees: Column, tx: Column, ty: Column) -> Column:
    """Scaled, rotated, moved."""
    r, x, y = F.radians(degrees), p["x"] * sx, p["y"] * sy
    return point(x * F.cos(r) - y * F.sin(r) + tx, x * F.sin(r) + y * F.cos(r) + ty)


def plan_to_lng_lat(p: Column, t: Column, off: Column) -> Column:
    """Plan units to struct(x: lng, y: lat). t: origin_lat, origin_lng, degrees, unit (meters), reflected."""
    flip = F.when(t["reflected"], -1).otherwise(1)
    u, v = (p["x"] + off["x"]) * t["unit"] * flip, -(p["y"] + off["y"]) * t["unit"]
    r = F.radians(t["degrees"])
    m_lat, m_lng = meters_per_degree(t["origin_lat"])
    east, north = u * F.cos(r) - v * F.sin(r), u * F.sin(r) + v * F.cos(r)
    return point(t["origin_lng"] + east / m_lng, t["origin_lat"] + north / m_lat)


def lng_lat_to_plan(q: Column, t: Column, off: Column) -> Column:
    """M16's inverse."""
    flip = F.when(t["reflected"], -1).otherwise(1)
    m_lat, m_lng = meters_per_degree(t["origin_lat"])
    east, north = (q["x"] - t["origin_lng"]) * m_lng, (q["y"] - t["origin_lat"]) * m_lat
    r = F.radians(t["degrees"])
    u, v = east * F.cos(r) + north * F.sin(r), -east * F.sin(r) + north * F.cos(r)
    return point(u / t["unit"] * flip - off["x"], -v / t["unit"] - off["y"])


def plan_bearing(dx: Column, dy: Column, t: Column) -> Column:
    """Degrees clockwise from north of a plan direction."""
    u, v, r = dx * F.when(t["reflected"], -1).otherwise(1), -dy, F.radians(t["degrees"])
    return F.pmod(F.degrees(F.atan2(u * F.cos(r) - v * F.sin(r), u * F.sin(r) + v * F.cos(r))), F.lit(360.0))


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle start bearing, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def circle(center: Column, r: float, n: int) -> Column:
    """A closed ring of n sides."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: point(center["x"] + r * F.cos(2 * math.pi * (i % n) / n), center["y"] + r * F.sin(2 * math.pi * (i % n) / n)))


def cone(center: Column, heading: Column, length: float, spread: float, steps: int = 8) -> Column:
    """A wedge along a heading from north, clockwise."""
    h = lambda i: F.radians(heading - spread / 2 + spread * i / steps)
    rim = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: point(center["x"] + length * F.sin(h(i)), center["y"] + length * F.cos(h(i))))
    return F.concat(F.array(center), rim, F.array(center))


def ring_iou(a: Column, b: Column, samples: int) -> Column:
    """Intersection over union on samples x samples cell centers of the common box; 0 if neither has one."""
    xs, ys = F.transform(F.concat(a, b), lambda p: p["x"]), F.transform(F.concat(a, b), lambda p: p["y"])
    x0, y0 = F.array_min(xs), F.array_min(ys)
    w, h = (F.array_max(xs) - x0) / samples, (F.array_max(ys) - y0) / samples
    cells = F.transform(F.sequence(F.lit(0), F.lit(samples * samples - 1)), lambda i: point(x0 + (i % samples + 0.5) * w, y0 + (F.floor(i / samples) + 0.5) * h))
    start = F.struct(F.lit(0).alias("both"), F.lit(0).alias("any"))

    def add(s: Column, p: Column) -> Column:
        i, j = in_ring(p, a), in_ring(p, b)
        return F.struct((s["both"] + F.when(i & j, 1).otherwise(0)).alias("both"), (s["any"] + F.when(i | j, 1).otherwise(0)).alias("any"))

    return F.aggregate(cells, start, add, lambda s: F.coalesce(F.try_divide(s["both"], s["any"]), F.lit(0.0)))


def corridor_shape(square_feet: Column, inradius: Column) -> Column:
    """struct(elong, narrow, long) of a room: its area in square inches over the squared inradius, which is in
    inches (1 at least); narrow up to 72 inches, long from 14."""
    r = F.greatest(F.lit(1.0), inradius * inradius)
    elong = square_feet * 144 / r
    return F.struct(elong.alias("elong"), (inradius <= 72).alias("narrow"), (elong >= 14).alias("long"))


def label_point(ring: Column, n: int = 19) -> Column:
    """The centroid if it is inside, else the grid point farthest within (first among equals)."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    x0, y0 = F.array_min(xs), F.array_min(ys)
    grid = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: point(x0 + (F.array_max(xs) - x0) * (i % n + 1) / (n + 1), y0 + (F.array_max(ys) - y0) * (F.floor(i / n) + 1) / (n + 1)))
    best = F.array_max(F.transform(grid, lambda p, i: F.struct(signed_ring_distance(p, ring).alias("d"), (-i).alias("i"), p.alias("p"))))["p"]
    c = centroid(ring)
    return F.when(in_ring(c, ring), c).otherwise(best)


def distance_outside(p: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """How far a point lies outside a box, 0 within."""
    zero = F.lit(0.0)
    dx, dy = F.greatest(west - p["x"], zero, p["x"] - east), F.greatest(south - p["y"], zero, p["y"] - north)
    return F.sqrt(dx * dx + dy * dy)


def box_overlap(a: Column, b: Column) -> Column:
    """Shared area of boxes with min_x, min_y, max_x, max_y."""
    w = F.least(a["max_x"], b["max_x"]) - F.greatest(a["min_x"], b["min_x"])
    h = F.least(a["max_y"], b["max_y"]) - F.greatest(a["min_y"], b["min_y"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def perimeter(ring: Column, closed: bool = True) -> Column:
    """M29."""
    d = F.zip_with(ring, rotated(ring), dist)
    return _total(d if closed else F.slice(d, 1, F.greatest(F.size(ring) - 1, F.lit(1))))


def shaft_area(points: Column) -> Column:
    """Area of the ring of the points in the order of their angles about the mean."""
    n = F.size(points)
    m = point(_total(F.transform(points, lambda p: p["x"])) / n, _total(F.transform(points, lambda p: p["y"])) / n)
    turned = F.array_sort(F.transform(points, lambda p: F.struct(F.atan2(p["y"] - m["y"], p["x"] - m["x"]).alias("a"), p["x"].alias("x"), p["y"].alias("y"))))
    return area(F.transform(turned, lambda q: point(q["x"], q["y"])))


def label_fits(chars: Column, size: Column, width: Column, height: Column, aspect: float = 0.6) -> Column:
    """A text of so many signs fits in a box."""
    return (chars * size * aspect <= width) & (size * 1.2 <= height)


def envelope(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The convex hull by monotone chain, counter-clockwise."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(reversed(pts))


def simplify(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """A polyline without points nearer than tolerance to the chord of what stays."""
    if len(points) < 3:
        return points
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        i, j = stack.pop()
        (ax, ay), (bx, by) = points[i], points[j]
        n = math.hypot(bx - ax, by - ay)
        far, at = tolerance, None
        for k in range(i + 1, j):
            px, py = points[k]
            d = abs((bx - ax) * (ay - py) - (ax - px) * (by - ay)) / n if n else math.hypot(px - ax, py - ay)
            if d > far:
                far, at = d, k
        if at is not None:
            keep.add(at)
            stack += [(i, at), (at, j)]
    return [points[k] for k in sorted(keep)]


def pole(ring: list[tuple[float, float]], precision: float) -> tuple[float, float, float]:
    """The point farthest inside a ring, with its distance, by halving promising cells."""
    import heapq

    def signed(x: float, y: float) -> float:
        inside, best = False, math.inf
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                inside = not inside
            n = (bx - ax) ** 2 + (by - ay) ** 2
            t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n)) if n else 0.0
            best = min(best, math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
        return best if inside else -best

    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    size = min(max(xs) - min(xs), max(ys) - min(ys))
    cells: list[tuple[float, float, float, float]] = []

    def push(x: float, y: float, h: float) -> float:
        d = signed(x, y)
        heapq.heappush(cells, (-(d + h * math.sqrt(2)), x, y, h))
        return d

    best = (sum(xs) / len(xs), sum(ys) / len(ys), signed(sum(xs) / len(xs), sum(ys) / len(ys)))
    if size <= 0:
        return best
    h = size / 2
    y = min(ys) + h
    while y - h < max(ys):
        x = min(xs) + h
        while x - h < max(xs):
            push(x, y, h)
            x += size
        y += size
    while cells:
        top, x, y, h = heapq.heappop(cells)
        if (d := signed(x, y)) > best[2]:
            best = (x, y, d)
        if -top - best[2] <= precision:
            break
        for dx in (-h / 2, h / 2):
            for dy in (-h / 2, h / 2):
                push(x + dx, y + dy, h / 2)
    return best


def _pairs(ring) -> list[tuple[float, float]]:
    return [(p["x"], p["y"]) for p in ring]


def arrow_functions():
    """M12, M14, M20 over columns of rings: simplify_udf(ring, tolerance), pole_udf(ring, precision), hull_udf(ring)."""
    @F.pandas_udf(f"array<{POINT}>")
    def simplify_udf(ring: pd.Series, tolerance: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else [{"x": x, "y": y} for x, y in simplify(_pairs(r), t)] for r, t in zip(ring, tolerance, strict=True)])

    @F.pandas_udf("struct<x:double,y:double,d:double>")
    def pole_udf(ring: pd.Series, precision: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pole(_pairs(r), p) if r is not None and len(r) > 2 else (None, None, None) for r, p in zip(ring, precision, strict=True)], columns=["x", "y", "d"])

    @F.pandas_udf(f"array<{POINT}>")
    def hull_udf(ring: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else [{"x": x, "y": y} for x, y in hull(_pairs(r))] for r in ring])

    return simplify_udf, pole_udf, hull_udf
