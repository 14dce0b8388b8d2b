"""Low-precision Sun and Earth (a hundredth of a degree), light time and nutation as Column expressions; angles in radians."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skylattice.functions.sphere import from_unit_vector, unit_vector

#: Seconds of light time for an astronomical unit, and the Julian day of the epoch.
AU_SECONDS, J2000 = 499.004784, 2451545.0


def sun_vector(jd: Column) -> tuple[Column, Column, Column]:
    """Equatorial vector to the Sun in astronomical units (almanac series)."""
    n = jd - J2000
    g, mean = F.radians(357.528 + 0.9856003 * n), F.radians(280.460 + 0.9856474 * n)
    lon = mean + F.radians(1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    r, tilt = 1.00014 - 0.01671 * F.cos(g) - 0.00014 * F.cos(2 * g), F.radians(23.439 - 0.0000004 * n)
    return r * F.cos(lon), r * F.cos(tilt) * F.sin(lon), r * F.sin(tilt) * F.sin(lon)


def sun_delay(jd: Column, lon: Column, lat: Column) -> Column:
    """Seconds from the arrival of the light of a direction at the Earth to that at the Sun."""
    return -sum(a * b for a, b in zip(sun_vector(jd), unit_vector(lon, lat), strict=True)) * AU_SECONDS


def heliocentric(jd: Column, lon: Column, lat: Column) -> Column:
    """Julian day at which the light of a direction passes the Sun."""
    return jd + sun_delay(jd, lon, lat) / 86400


def with_parallax(jd: Column, lon: Column, lat: Column, pm_lon: Column, pm_lat: Column, parallax: Column, years: Column) -> tuple[Column, Column]:
    """Position after proper motion (great-circle rates a year) and annual parallax."""
    u = unit_vector(lon, lat)
    east = (-F.sin(lon), F.cos(lon), F.lit(0.0))
    north = (-F.sin(lat) * F.cos(lon), -F.sin(lat) * F.sin(lon), F.cos(lat))
    return from_unit_vector(*[u[i] + years * (pm_lon * east[i] + pm_lat * north[i]) + parallax * s for i, s in enumerate(sun_vector(jd))])


def nutation(jd: Column) -> tuple[Column, Column]:
    """Nutation in longitude and in obliquity: the four largest terms of each."""
    t = (jd - J2000) / 36525
    node, sun, moon = (F.radians(a + b * t) for a, b in ((125.04452, -1934.136261), (280.4665, 36000.7698), (218.3165, 481267.8813)))
    psi = -17.20 * F.sin(node) - 1.32 * F.sin(2 * sun) - 0.23 * F.sin(2 * moon) + 0.21 * F.sin(2 * node)
    eps = 9.20 * F.cos(node) + 0.57 * F.cos(2 * sun) + 0.10 * F.cos(2 * moon) - 0.09 * F.cos(2 * node)
    return F.radians(psi / 3600), F.radians(eps / 3600)


def reduced_magnitude(mag: Column, r: Column, delta: Column, phase_angle: Column, slope: float = 0.15) -> Column:
    """Magnitude at unit distances and zero phase angle (two-term phase law)."""
    x = F.tan(phase_angle / 2)
    law = (1 - slope) * F.exp(-3.33 * F.pow(x, 0.63)) + slope * F.exp(-1.87 * F.pow(x, 1.22))
    return mag - 5 * F.log10(r * delta) + 2.5 * F.log10(law)


def left_at(jd: Column, delta: Column) -> Column:
    """Time at which light left an object at a distance (astronomical units)."""
    return jd - delta * (AU_SECONDS / 86400)
