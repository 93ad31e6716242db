"""Ring and distance expressions over arrays of points (structs x, y), JVM-side; what needs search is in ``shapes``."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius in metres; half the width of the Mercator plane; GRS80 and the UTM scale.
EARTH_M, MERCATOR = 6371008.8, 20037508.342789244
GRS80_A, GRS80_F, UTM_K = 6378137.0, 1 / 298.257222101, 0.9996


def xy_ring(ring: Column) -> Column:
    """Positions with only x and y."""
    return F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def _steps(ring: Column) -> Column:
    return F.sequence(F.lit(1), F.size(ring) - 1)


def signed_area(ring: Column) -> Column:
    """Over consecutive pairs; counter-clockwise is positive."""
    at = lambda i: F.get(ring, i)
    total = F.aggregate(_steps(ring), F.lit(0.0), lambda s, i: s + (at(i - 1)["x"] * at(i)["y"] - at(i)["x"] * at(i - 1)["y"]))
    return F.when(F.size(ring) > 1, total / 2).otherwise(0.0)


def vertex_count(rings: Column) -> Column:
    """Vertices without the closing ones."""
    return F.aggregate(rings, F.lit(0), lambda s, r: s + F.greatest(F.lit(0), F.size(r) - 1))


def is_closed(ring: Column) -> Column:
    return (F.size(ring) > 0) & (F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1))


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["max_x"] >= b["min_x"]) & (a["min_x"] <= b["max_x"]) & (a["max_y"] >= b["min_y"]) & (a["min_y"] <= b["max_y"])


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length)))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def boundary_distance(px: Column, py: Column, ring: Column) -> Column:
    at = lambda i: F.get(ring, i)
    return F.array_min(F.transform(_steps(ring), lambda i: segment_distance(px, py, at(i - 1)["x"], at(i - 1)["y"], at(i)["x"], at(i)["y"])))


def inside(px: Column, py: Column, ring: Column) -> Column:
    """Ray casting; the boundary itself is not judged here."""
    at = lambda i: F.get(ring, i)

    def crosses(i: Column) -> Column:
        a, b = at(i - 1), at(i)
        across = (a["y"] > py) != (b["y"] > py)
        return F.when(across & (px < (b["x"] - a["x"]) * (py - a["y"]) / F.when(b["y"] == a["y"], None).otherwise(b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

    return F.aggregate(_steps(ring), F.lit(0), lambda s, i: s + crosses(i)) % 2 == 1


def covers(px: Column, py: Column, ring: Column) -> Column:
    """Inside or on the boundary."""
    return inside(px, py, ring) | (boundary_distance(px, py, ring) == 0)


def polygon_distance(px: Column, py: Column, ring: Column) -> Column:
    """0 inside, else to the boundary."""
    return F.when(inside(px, py, ring), 0.0).otherwise(boundary_distance(px, py, ring))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def mercator_to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    return x / MERCATOR * 180, F.degrees(2 * F.atan(F.exp(y / MERCATOR * math.pi)) - math.pi / 2)


def _series() -> tuple[float, list[float], list[float], list[float]]:
    n = GRS80_F / (2 - GRS80_F)
    radius = GRS80_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    return radius, alpha, beta, delta


def utm_to_wgs84(x: Column, y: Column, zone: int = 30) -> tuple[Column, Column]:
    """Easting and northing (north) to longitude and latitude, by the Kruger series on GRS80."""
    radius, _, beta, delta = _series()
    xi, eta = y / (UTM_K * radius), (x - 500000.0) / (UTM_K * radius)
    xi1, eta1 = xi, eta
    for j, b in enumerate(beta, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(F.atan(F.sinh(eta1) / F.cos(xi1))) + (zone * 6 - 183), F.degrees(lat)


def wgs84_to_utm(lon: Column, lat: Column, zone: int = 30) -> tuple[Column, Column]:
    radius, alpha, _, _ = _series()
    n = GRS80_F / (2 - GRS80_F)
    c = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    atanh = lambda v: F.log((1 + v) / (1 - v)) / 2
    t = F.sinh(atanh(F.sin(phi)) - c * atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + UTM_K * radius * x, UTM_K * radius * y


def small_ring_signature(ring: Column) -> Column:
    """The least rotation of a short ring of texts or of its reverse, without the closing point; long rings: ``shapes``."""
    open_ring = F.when(is_closed(ring) & (F.size(ring) > 1), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)

    def least(r: Column) -> Column:
        return F.array_min(F.transform(F.sequence(F.lit(1), F.size(r)), lambda i: F.array_join(F.slice(F.concat(r, r), i, F.size(r)), ";")))

    return F.least(least(open_ring), least(F.reverse(open_ring)))


def ring_record(ring: Column) -> Column:
    """What the structure of a ring is: positions, distinct vertices, closed, consecutive repeats, orientation."""
    n = F.size(ring)
    closed = (n > 0) & (F.get(ring, F.lit(0)) == F.get(ring, n - 1))
    body = F.when(closed & (n > 1), F.slice(ring, 1, n - 1)).otherwise(ring)
    again = F.filter(ring, lambda p, i: (i > 0) & (p == F.get(ring, i - 1)))
    area = signed_area(ring)
    way = F.when(n < 4, "none").when(area > 0, "counterclockwise").when(area < 0, "clockwise").otherwise("none")
    return F.struct(n.alias("positions"), F.size(F.array_distinct(body)).alias("distinct_vertices"), F.coalesce(closed, F.lit(False)).alias("closed"), F.size(again).alias("repeats"), way.alias("orientation"))


def representative_point(ring: Column) -> Column:
    """A point inside a ring: the middle of the widest inner span at half its height, the first of equals; else its box's centre."""
    box = bounds(ring)
    y = (box["min_y"] + box["max_y"]) / 2
    at = lambda i: F.get(ring, i)
    crossing = lambda i: F.when((at(i - 1)["y"] > y) != (at(i)["y"] > y), at(i - 1)["x"] + (y - at(i - 1)["y"]) * (at(i)["x"] - at(i - 1)["x"]) / (at(i)["y"] - at(i - 1)["y"]))
    xs = F.array_sort(F.array_compact(F.transform(_steps(ring), crossing)))
    spans = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(xs) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct((F.get(xs, 2 * i + 1) - F.get(xs, 2 * i)).alias("w"), (-F.get(xs, 2 * i)).alias("left"), ((F.get(xs, 2 * i) + F.get(xs, 2 * i + 1)) / 2).alias("x")))
    best = F.array_max(spans)
    return F.struct(F.coalesce(best["x"], (box["min_x"] + box["max_x"]) / 2).alias("x"), y.alias("y"))
