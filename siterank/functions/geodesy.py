"""Map projection and geometry as pure column expressions (no external library)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# WGS84 and UTM zone 43N, fixed values
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0
CENTRAL_MERIDIAN = 75.0
EARTH_MEAN_RADIUS = 6371008.8
METRES_PER_DEGREE_LON = 111320.0
METRES_PER_DEGREE_LAT = 111132.0

_E2 = FLATTENING * (2 - FLATTENING)
_EP2 = _E2 / (1 - _E2)
# meridian arc series: coefficients of lat, sin 2lat, sin 4lat, sin 6lat
_ARC = (
    1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256,
    -(3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024),
    15 * _E2**2 / 256 + 45 * _E2**3 / 1024,
    -35 * _E2**3 / 3072,
)


def degrees_from_dms(d, m, s) -> Column:
    return d + m / F.lit(60.0) + s / F.lit(3600.0)


def _poly(x: Column, coefficients) -> Column:
    """Horner form, constant first."""
    out = coefficients[-1] if isinstance(coefficients[-1], Column) else F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + (c if isinstance(c, Column) else F.lit(float(c)))
    return out


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Transverse Mercator forward series (Snyder 8-9, 8-10)."""
    phi = F.radians(lat)
    s, c, t = F.sin(phi), F.cos(phi), F.pow(F.tan(phi), F.lit(2.0))
    nu = SEMI_MAJOR / F.sqrt(1 - _E2 * s * s)
    eta = _EP2 * c * c
    a = c * (F.radians(lon) - math.radians(CENTRAL_MERIDIAN))
    a2 = a * a
    arc = SEMI_MAJOR * (_ARC[0] * phi + _ARC[1] * F.sin(2 * phi) + _ARC[2] * F.sin(4 * phi) + _ARC[3] * F.sin(6 * phi))
    east = a * _poly(a2, [1.0, (1 - t + eta) / 6, (5 - 18 * t + t * t + 72 * eta - 58 * _EP2) / 120])
    north = a2 * _poly(a2, [F.lit(0.5), (5 - t + 9 * eta + 4 * eta * eta) / 24,
                            (61 - 58 * t + t * t + 600 * eta - 330 * _EP2) / 720])
    return FALSE_EASTING + SCALE * nu * east, SCALE * (arc + nu * F.tan(phi) * north)


def from_utm(easting: Column, northing: Column) -> tuple[Column, Column]:
    """Inverse series (Snyder 8-17, 8-18): longitude, latitude in degrees."""
    root = math.sqrt(1 - _E2)
    e1 = (1 - root) / (1 + root)
    mu = northing / (SCALE * SEMI_MAJOR * _ARC[0])
    foot = (mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
            + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu))
    s, c = F.sin(foot), F.cos(foot)
    t = F.pow(F.tan(foot), F.lit(2.0))
    eta = _EP2 * c * c
    w = 1 - _E2 * s * s
    nu, rho = SEMI_MAJOR / F.sqrt(w), SEMI_MAJOR * (1 - _E2) / F.pow(w, F.lit(1.5))
    d = (easting - FALSE_EASTING) / (nu * SCALE)
    d2 = d * d
    lat = foot - (nu * F.tan(foot) / rho) * d2 * _poly(d2, [
        F.lit(0.5), -(5 + 3 * t + 10 * eta - 4 * eta * eta - 9 * _EP2) / 24,
        (61 + 90 * t + 298 * eta + 45 * t * t - 252 * _EP2 - 3 * eta * eta) / 720])
    lon = d * _poly(d2, [F.lit(1.0), -(1 + 2 * t + eta) / 6,
                         (5 - 2 * eta + 28 * t - 3 * eta * eta + 8 * _EP2 + 24 * t * t) / 120]) / c
    return CENTRAL_MERIDIAN + F.degrees(lon), F.degrees(lat)


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_MEAN_RADIUS * F.asin(F.sqrt(h))


def circle_ring(x: Column, y: Column, radius: Column, vertices: int = 96) -> Column:
    """Closed ring of a circle as an array of points rounded to millimetres."""
    angle = lambda i: i * F.lit(2 * math.pi) / F.lit(float(vertices))
    return F.transform(
        F.sequence(F.lit(0), F.lit(vertices)),
        lambda i: F.array(F.round(x + radius * F.cos(angle(i)), 3), F.round(y + radius * F.sin(angle(i)), 3)),
    )


def circle_overlap(distance: Column, radius: Column) -> tuple[Column, Column]:
    """Lens area of two equal circles and its Jaccard share."""
    r2 = radius * radius
    inside = distance < 2 * radius
    ratio = F.least(distance / (2 * radius), F.lit(1.0))
    lens = 2 * r2 * F.acos(ratio) - distance / 2 * F.sqrt(F.greatest(4 * r2 - distance * distance, F.lit(0.0)))
    area = F.when(inside, lens).otherwise(0.0)
    return area, F.when(area > 0, area / (2 * math.pi * r2 - area)).otherwise(0.0)
