"""Geometry on points in degrees, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_KM = 6371.0
METRES_PER_DEGREE = 111_320.0


def half_up(x: Column, per_unit: float = 1.0) -> Column:
    """x rounded to 1 / per_unit, halves upwards."""
    return F.floor(x * per_unit + F.lit(0.5)) / F.lit(float(per_unit))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2.0)) * F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
    return 2 * EARTH_KM * F.asin(F.sqrt(h))


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial course in degrees, clockwise from north, in [0, 360)."""
    d = F.radians(lng2 - lng1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def angle_delta(a: Column, b: Column) -> Column:
    """The angle between two courses, in [0, 180]."""
    d = F.abs((a - b) % 360.0)
    return F.when(d > 180, 360 - d).otherwise(d)


def folded_angle(a: Column, b: Column) -> Column:
    """The angle between two lines without direction: 0 along, 90 across."""
    d = angle_delta(a, b)
    return F.least(d, 180 - d)


def on_segment(lat: Column, lng: Column, a_lat: Column, a_lng: Column, b_lat: Column, b_lng: Column) -> tuple[Column, Column]:
    """Distance in metres from a point to a segment, and where on the segment (0 to 1) its nearest point lies.

    The plane is tangent at the point.
    """
    east = F.cos(F.radians(lat)) * METRES_PER_DEGREE
    ax, ay = (a_lng - lng) * east, (a_lat - lat) * METRES_PER_DEGREE
    bx, by = (b_lng - lng) * east, (b_lat - lat) * METRES_PER_DEGREE
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * dx + ay * dy) / length)))
    cx, cy = ax + t * dx, ay + t * dy
    return F.sqrt(cx * cx + cy * cy), t


def padded_box(min_lat: Column, max_lat: Column, min_lng: Column, max_lng: Column, metres: float) -> dict[str, Column]:
    """A box with a margin of so many metres on each side."""
    lat = F.lit(metres / METRES_PER_DEGREE)
    lng = lat / F.greatest(F.lit(0.2), F.cos(F.radians(F.greatest(F.abs(min_lat), F.abs(max_lat)))))
    return {"min_lat": min_lat - lat, "max_lat": max_lat + lat, "min_lng": min_lng - lng, "max_lng": max_lng + lng}


def utm_to_wgs84(east: Column, north: Column, zone: Column) -> tuple[Column, Column]:
    """Latitude and longitude of UTM coordinates on the WGS84 ellipsoid, by the usual series in the footpoint latitude."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    e1 = (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    mu = north / k0 / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    foot = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu)
    sin, cos, tan = F.sin(foot), F.cos(foot), F.tan(foot)
    c, t = ep2 * cos * cos, tan * tan
    n = a / F.sqrt(1 - e2 * sin * sin)
    r = a * (1 - e2) / F.pow(1 - e2 * sin * sin, F.lit(1.5))
    d = (east - 500000.0) / (n * k0)
    d2 = d * d
    lat = foot - (n * tan / r) * (d2 / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * d2 * d2 / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * d2 * d2 * d2 / 720)
    lng = (d - (1 + 2 * t + c) * d2 * d / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * d2 * d2 * d / 120) / cos
    return F.degrees(lat), F.degrees(lng) + zone * 6 - 183


# The bounds of plausible positions (south, north, west, east), and the wider ones that tell swapped coordinates.
PLAUSIBLE, NATIONWIDE = (47.2, 55.1, 5.8, 15.1), (46.0, 56.0, 4.0, 16.0)


def within(lat: Column, lng: Column, bounds: tuple[float, float, float, float] = PLAUSIBLE) -> Column:
    return F.coalesce(lat.between(*bounds[:2]) & lng.between(*bounds[2:]), F.lit(False))


def swapped_right(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Latitude and longitude in their right order; null where neither order lies within the nationwide bounds."""
    straight, crossed = within(lat, lng, NATIONWIDE), within(lng, lat, NATIONWIDE)
    return F.when(straight, lat).when(crossed, lng), F.when(straight, lng).when(crossed, lat)


def beside(lat: Column, lng: Column, a_lat: Column, a_lng: Column, b_lat: Column, b_lng: Column, km: Column, side: Column) -> tuple[Column, Column]:
    """A point so many kilometres beside a line at one of its points, across the course from a to b; side is 1 for left, -1 for right."""
    narrow = F.cos(F.radians(lat))
    dx, dy = (b_lng - a_lng) * narrow, b_lat - a_lat
    length = F.sqrt(dx * dx + dy * dy)
    length = F.when(length == 0, 1.0).otherwise(length)
    degrees = km / (METRES_PER_DEGREE / 1000)
    return lat + dx / length * side * degrees, lng - dy / length * side * degrees / narrow


def around(lat: Column, lng: Column, from_lat: Column, from_lng: Column, to_lat: Column, to_lng: Column, km: float, side: Column) -> tuple[Column, Column]:
    """A point so many kilometres from a blocked one, across the air line of a trip; side is -1 for west, 1 for east."""
    narrow = F.cos(F.radians((from_lat + to_lat) / 2))
    d_lat, d_lng = to_lat - from_lat, (to_lng - from_lng) * narrow
    length = F.sqrt(d_lat * d_lat + d_lng * d_lng)
    length = F.when(length == 0, 1.0).otherwise(length)
    return lat - side * d_lng / length * km / 111, lng + side * d_lat / length * km / 111 / narrow
