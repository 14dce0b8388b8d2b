"""Spherical and planar geometry as Column expressions; every angle is in radians unless it says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI, TWO_PI = math.pi, 2 * math.pi


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance; stable for tiny separations."""
    s = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), s)))


def sphere_dist(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance by arc cosine, its argument clamped to [-1, 1]."""
    c = F.sin(lat1) * F.sin(lat2) + F.cos(lat1) * F.cos(lat2) * F.cos(lon1 - lon2)
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))


def sphere_dist_small(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Flat approximation for small separations."""
    d = wrap_pi(lon1 - lon2) * F.cos((lat1 + lat2) / 2)
    return F.sqrt(d * d + (lat1 - lat2) * (lat1 - lat2))


def sphere_dist_thresh(lon1: Column, lat1: Column, lon2: Column, lat2: Column, limit: float) -> Column:
    """Distance where the latitudes differ by less than ``limit``, else null."""
    return F.when(F.abs(lat1 - lat2) < limit, sphere_dist(lon1, lat1, lon2, lat2))


def position_angle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Direction from the first to the second point, from north through east, in [0, 2 pi)."""
    y = F.sin(lon2 - lon1) * F.cos(lat2)
    x = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lon2 - lon1)
    return wrap_2pi(F.atan2(y, x))


def wrap_2pi(a: Column, period: float = TWO_PI) -> Column:
    """Angle in [0, period); one that is less than rounding below 0 becomes the last number below the period, not 0."""
    m = a % F.lit(period)
    return F.when(m < 0, F.least(m + period, F.lit(math.nextafter(period, 0.0)))).otherwise(m)


def wrap_pi(a: Column, half: float = PI) -> Column:
    """Angle in (-half, half]."""
    p = F.pmod(a, F.lit(2 * half))
    return F.when(p > half, p - 2 * half).otherwise(p)


def unit_vector(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def from_unit_vector(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Longitude in [0, 2 pi) and latitude of a vector of any length."""
    return wrap_2pi(F.atan2(y, x)), F.atan2(z, F.sqrt(x * x + y * y))


def chord_dist(v1: tuple, v2: tuple) -> Column:
    """Angle between unit vectors."""
    dot = sum(a * b for a, b in zip(v1, v2, strict=True))
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))


def cross(a: tuple, b: tuple) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def offset(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> tuple[Column, Column]:
    """Offsets from the first to the second point along longitude (a great-circle length) and latitude."""
    d, pa = haversine(lon1, lat1, lon2, lat2), position_angle(lon1, lat1, lon2, lat2)
    return d * F.sin(pa), d * F.cos(pa)


def move(lon: Column, lat: Column, dist: Column, pa: Column) -> tuple[Column, Column]:
    """The point at a distance and position angle."""
    s = F.sin(lat) * F.cos(dist) + F.cos(lat) * F.sin(dist) * F.cos(pa)
    dl = F.atan2(F.sin(pa) * F.sin(dist) * F.cos(lat), F.cos(dist) - F.sin(lat) * s)
    return wrap_2pi(lon + dl), F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), s)))


def rotate(lon: Column, lat: Column, matrix: list[list[float]]) -> tuple[Column, Column]:
    """Longitude and latitude after a rotation of the unit vector."""
    v = unit_vector(lon, lat)
    return from_unit_vector(*[sum(F.lit(m) * c for m, c in zip(row, v, strict=True)) for row in matrix])


#: Mean obliquity at J2000 (degrees) and the J2000 equatorial-to-galactic rotation.
OBLIQUITY = 23.4392911
TO_GALACTIC = [[-0.0548755604, -0.8734370902, -0.4838350155], [0.4941094279, -0.4448296300, 0.7469822445], [-0.8676661490, -0.1980763734, 0.4559837762]]


def to_galactic(lon: Column, lat: Column) -> tuple[Column, Column]:
    return rotate(lon, lat, TO_GALACTIC)


def from_galactic(lon: Column, lat: Column) -> tuple[Column, Column]:
    return rotate(lon, lat, [list(r) for r in zip(*TO_GALACTIC, strict=True)])


def ecliptic_matrix(degrees: float = OBLIQUITY) -> list[list[float]]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return [[1.0, 0.0, 0.0], [0.0, c, s], [0.0, -s, c]]


def to_ecliptic(lon: Column, lat: Column) -> tuple[Column, Column]:
    return rotate(lon, lat, ecliptic_matrix())


def from_ecliptic(lon: Column, lat: Column) -> tuple[Column, Column]:
    return rotate(lon, lat, [list(r) for r in zip(*ecliptic_matrix(), strict=True)])


def precession_matrix(jd: float) -> list[list[float]]:
    """Rotation from J2000 to the mean equator of a Julian day (IAU 1976 angles)."""
    t = (jd - 2451545.0) / 36525
    z1, z2, th = (math.radians(p / 3600) for p in (2306.2181 * t + 0.30188 * t**2 + 0.017998 * t**3, 2306.2181 * t + 1.09468 * t**2 + 0.018203 * t**3, 2004.3109 * t - 0.42665 * t**2 - 0.041833 * t**3))
    a, b, c, d, e, f = math.cos(z1), math.sin(z1), math.cos(z2), math.sin(z2), math.cos(th), math.sin(th)
    return [[a * c * e - b * d, -b * c * e - a * d, -c * f], [a * d * e + b * c, -b * d * e + a * c, -d * f], [a * f, -b * f, e]]


def altaz(hour_angle: Column, dec: Column, latitude: float) -> tuple[Column, Column]:
    """Azimuth (from north through east) and altitude."""
    la = F.lit(latitude)
    alt = F.asin(F.sin(dec) * F.sin(la) + F.cos(dec) * F.cos(hour_angle) * F.cos(la))
    az = F.atan2(-F.cos(dec) * F.sin(hour_angle), F.sin(dec) * F.cos(la) - F.cos(dec) * F.cos(hour_angle) * F.sin(la))
    return wrap_2pi(az), alt


def hadec(az: Column, alt: Column, latitude: float) -> tuple[Column, Column]:
    """Hour angle and declination of an azimuth and altitude."""
    la = F.lit(latitude)
    dec = F.asin(F.sin(alt) * F.sin(la) + F.cos(alt) * F.cos(az) * F.cos(la))
    ha = F.atan2(-F.cos(alt) * F.sin(az), F.sin(alt) * F.cos(la) - F.cos(alt) * F.cos(az) * F.sin(la))
    return wrap_2pi(ha), dec


def hardie_airmass(zenith: Column) -> Column:
    """Air mass by Hardie's polynomial in sec z - 1."""
    s = 1 / F.cos(zenith) - 1
    return 1 + s - 0.0018167 * s - 0.002875 * s * s - 0.0008083 * s * s * s


def parallactic_angle(hour_angle: Column, dec: Column, latitude: float) -> Column:
    return F.atan2(F.sin(hour_angle), F.lit(math.tan(latitude)) * F.cos(dec) - F.sin(dec) * F.cos(hour_angle))


def refraction(alt: Column) -> Column:
    """Saemundsson's mean refraction of a true altitude."""
    d = F.degrees(alt)
    return F.radians(1.02 / F.tan(F.radians(d + 10.3 / (d + 5.11))) / 60)


def triangle_area(a: tuple, b: tuple, c: tuple) -> Column:
    """Solid angle of a spherical triangle of three unit vectors."""
    n = cross(b, c)
    triple = F.abs(sum(x * y for x, y in zip(a, n, strict=True)))
    dot = lambda u, v: sum(x * y for x, y in zip(u, v, strict=True))
    return 2 * F.atan2(triple, 1 + dot(a, b) + dot(b, c) + dot(c, a))


def point_to_great_circle(lon: Column, lat: Column, pole_lon: Column, pole_lat: Column) -> Column:
    """Distance of a point from the great circle with a pole."""
    return F.abs(PI / 2 - sphere_dist(lon, lat, pole_lon, pole_lat))


def gnomonic(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Tangent-plane projection."""
    c0, s0 = math.cos(lat0), math.sin(lat0)
    c = s0 * F.sin(lat) + c0 * F.cos(lat) * F.cos(lon - lon0)
    return F.cos(lat) * F.sin(lon - lon0) / c, (c0 * F.sin(lat) - s0 * F.cos(lat) * F.cos(lon - lon0)) / c


def hammer_aitoff(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Equal-area projection of the whole sphere; longitude in (-pi, pi]."""
    k = F.sqrt(1 + F.cos(lat) * F.cos(lon / 2))
    return 2 * math.sqrt(2) * F.cos(lat) * F.sin(lon / 2) / k, math.sqrt(2) * F.sin(lat) / k


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return lon, F.log(F.tan(PI / 4 + lat / 2))


def proper_motion(lon: Column, lat: Column, pm_lon: Column, pm_lat: Column, years: Column) -> tuple[Column, Column]:
    """Position after a time; pm_lon is a great-circle rate."""
    dx, dy = pm_lon * years, pm_lat * years
    return move(lon, lat, F.sqrt(dx * dx + dy * dy), F.atan2(dx, dy))


def aberrated(lon: Column, lat: Column, velocity: tuple[float, float, float]) -> tuple[Column, Column]:
    """Apparent position for an observer's velocity in units of the speed of light (first order in it)."""
    return from_unit_vector(*[x + v for x, v in zip(unit_vector(lon, lat), velocity, strict=True)])


def plane_dist(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def plane_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.atan2(y2 - y1, x2 - x1)


def line_dist(x: Column, y: Column, slope: float, intercept: float) -> Column:
    """Distance of a point from the line y = slope x + intercept."""
    return F.abs(slope * x - y + intercept) / math.sqrt(slope * slope + 1)


def affine(x: Column, y: Column, m: list[list[float]]) -> tuple[Column, Column]:
    """Affine transformation by a 2x3 matrix."""
    return m[0][0] * x + m[0][1] * y + m[0][2], m[1][0] * x + m[1][1] * y + m[1][2]


def polygon_area(corners: list[tuple[Column, Column]]) -> Column:
    """Solid angle of a convex spherical polygon of (longitude, latitude) corners: triangles from the first one."""
    v = [unit_vector(*c) for c in corners]
    return sum((triangle_area(v[0], v[i], v[i + 1]) for i in range(1, len(v) - 1)), F.lit(0.0))


def observable(hour_angle: Column, dec: Column, latitude: float, min_alt: float, max_airmass: float, max_hour_angle: float) -> Column:
    """High enough, with little enough air, near enough to the meridian."""
    alt = altaz(hour_angle, dec, latitude)[1]
    return (alt > min_alt) & (hardie_airmass(PI / 2 - alt) < max_airmass) & (F.abs(wrap_pi(hour_angle)) < max_hour_angle)


def cone_meets_polygon(lon: Column, lat: Column, radius: float, poles: list[tuple[float, float]]) -> Column:
    """A cone overlaps a polygon given by the poles of its sides: it is nearer than a quarter turn and its radius to each."""
    out = F.lit(True)
    for a, b in poles:
        out = out & (sphere_dist(lon, lat, F.lit(a), F.lit(b)) < PI / 2 + radius)
    return out
