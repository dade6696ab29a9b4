"""Plane and sphere geometry as Column expressions.

Coordinates are degrees. ``PI`` is the short constant with which the parity
values of angles and projections are defined; probes at a bearing use the full
one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PI = 3.1415926
CELL = 0.001
ORIGIN_LAT, ORIGIN_LON, METERS = 40.0, -70.0, 111111.0
BINS, BIN_DEGREES = 72, 5.0
NO_SCORE, LOW_SCORE, TINY = -10000.0, -1000.0, 1e-8


def planar(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in plain degrees."""
    return F.sqrt((lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2))


def shrink(lat: Column, pi: float = PI) -> Column:
    """The length of a degree of longitude as a share of one of latitude."""
    return F.cos(lat / F.lit(360.0) * F.lit(pi * 2.0))


def latlon_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, pi: float = PI) -> Column:
    """Distance with longitudes shrunk at the first point's latitude."""
    dx, dy = lat1 - lat2, (lon1 - lon2) * shrink(lat1, pi)
    return F.sqrt(dx * dx + dy * dy)


def to_meters(lat: Column, lon: Column) -> Column:
    """A struct of metres north (x) and east (y) of the fixed origin."""
    return F.struct(((lat - ORIGIN_LAT) * METERS).alias("x"), ((lon - ORIGIN_LON) * METERS * shrink(lat)).alias("y"))


def circle_line(x1: Column, y1: Column, x2: Column, y2: Column, r: Column) -> Column:
    """Where the line from point 1 to 2 meets the circle of radius r around the origin: a1 >= a2 as shares of the segment, -1 for both where it doesn't."""
    dx, dy = x2 - x1, y2 - y1
    a, b, c = dx * dx + dy * dy, 2.0 * (x1 * dx + y1 * dy), x1 * x1 + y1 * y1 - r * r
    root = b * b - 4.0 * a * c
    at = lambda sign: F.when((root > 0) & (a > 0), (-b + sign * F.sqrt(F.greatest(root, F.lit(0.0)))) / F.nullif(2.0 * a, F.lit(0.0))).otherwise(-1.0)
    return F.struct(at(1.0).alias("a1"), at(-1.0).alias("a2"))


def heading(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Angle from east, in (-180, 180]."""
    return F.atan2(lat2 - lat1, (lon2 - lon1) * shrink(lat1)) / F.lit(PI * 2.0) * F.lit(360.0)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Angle from north, in [0, 360)."""
    angle = F.atan2((lon2 - lon1) * shrink(lat1), lat2 - lat1) / F.lit(PI * 2.0) * F.lit(360.0)
    return F.when(angle < 0, angle + 360.0).otherwise(angle)


def bin_difference(a: Column, b: Column, bins: int = BINS) -> Column:
    """Steps between two directions on the circle of bins."""
    d = F.abs(a - b)
    return F.least(d, bins - d)


def lerp(a: Column, b: Column, alpha: Column) -> Column:
    return a * (1.0 - alpha) + b * alpha


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment; to its end where the foot lies outside, to the point for a segment without length."""
    dx, dy = bx - ax, by - ay
    length = F.sqrt(dx * dx + dy * dy)
    along = ((px - ax) * dx + (py - ay) * dy) / F.nullif(length, F.lit(0.0))
    foot = F.abs((px - ax) * dy - (py - ay) * dx) / F.nullif(length, F.lit(0.0))
    return F.when(length == 0, planar(px, py, ax, ay)).when(along < 0, planar(px, py, ax, ay)).when(along > length, planar(px, py, bx, by)).otherwise(foot)


def ray_segment(px: Column, py: Column, dx: Column, dy: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where a ray from (px, py) along (dx, dy) hits the segment a-b: x, y, the distance along the ray in its direction's units, and ok."""
    ex, ey = bx - ax, by - ay
    t = dx * ey - dy * ex
    safe = F.nullif(t, F.lit(0.0))
    along = ((ax - px) * ey - (ay - py) * ex) / safe
    share = ((ax - px) * dy - (ay - py) * dx) / safe
    ok = F.coalesce((t != 0) & (along >= 0) & (share >= 0) & (share <= 1), F.lit(False))
    none = F.lit(0.0)
    return F.struct(F.when(ok, px + along * dx).otherwise(none).alias("x"), F.when(ok, py + along * dy).otherwise(none).alias("y"), F.when(ok, along).otherwise(none).alias("length"), ok.alias("ok"))


def segments_cross(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Whether segments a-b and c-d cross properly; points are (x, y) pairs of Columns."""
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)


def unit(dlat: Column, dlon: Column, lat: float = 40.0) -> Column:
    """A direction of length one in distances at a latitude."""
    k = math.cos(math.radians(lat))
    n = F.nullif(F.sqrt(dlat * dlat + (dlon * k) * (dlon * k)), F.lit(0.0))
    return F.struct((dlat / n).alias("dlat"), (dlon / n).alias("dlon"))


def cell_lat(lat: Column) -> Column:
    return F.floor(lat / F.lit(CELL)).cast("int")


def cell_lon(lon: Column) -> Column:
    """Cells count westwards."""
    return F.floor(-lon / F.lit(CELL)).cast("int")


def probe(lat: Column, lon: Column, distance: Column, degrees: Column) -> Column:
    """The point at a bearing and distance."""
    angle = F.radians(degrees)
    return F.struct((lat + distance * F.cos(angle)).alias("lat"), (lon + distance * F.sin(angle) / F.cos(F.radians(lat))).alias("lon"))


def activation(count: Column, threshold: Column | int, low: float = LOW_SCORE) -> Column:
    """The logarithm of a count that reaches the threshold, else ``low``."""
    return F.when(count >= threshold, F.log(count + F.lit(TINY))).otherwise(F.lit(low))


def in_region(lat: Column, lon: Column, region: tuple[float, float, float, float], margin: float = 0.0) -> Column:
    """Whether a point is inside (min_lat, min_lon, max_lat, max_lon), less a margin on every side."""
    a, b, c, d = region
    return lat.between(a + margin, c - margin) & lon.between(b + margin, d - margin)


def pixel(value: Column, low: float, high: float, size: int) -> Column:
    """The pixel of a coordinate, cut towards zero."""
    return ((value - F.lit(low)) / F.lit(high - low) * F.lit(float(size))).cast("int")
