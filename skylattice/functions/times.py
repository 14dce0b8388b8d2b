"""Julian days, calendar parts and sidereal time as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIX_JD, MJD0, J2000 = 2440587.5, 2400000.5, 2451545.0
#: First Julian day and TAI-UTC seconds from then on.
LEAP_SECONDS = ((2441317.5, 10), (2441499.5, 11), (2441683.5, 12), (2442048.5, 13), (2442413.5, 14), (2442778.5, 15), (2443144.5, 16), (2443509.5, 17), (2443874.5, 18), (2444239.5, 19), (2444786.5, 20), (2445151.5, 21), (2445516.5, 22), (2446247.5, 23), (2447161.5, 24), (2447892.5, 25), (2448257.5, 26), (2448804.5, 27), (2449169.5, 28), (2449534.5, 29), (2450083.5, 30), (2450630.5, 31), (2451179.5, 32), (2453736.5, 33), (2454832.5, 34), (2456109.5, 35), (2457204.5, 36), (2457754.5, 37))


def jd(ts: Column) -> Column:
    """Julian day of a timestamp (taken as UTC)."""
    return F.unix_micros(ts.cast("timestamp")) / 86400e6 + UNIX_JD


def from_jd(day: Column) -> Column:
    """Timestamp of a Julian day, to the microsecond."""
    return F.timestamp_micros(F.round((day - UNIX_JD) * 86400e6).cast("bigint"))


def mjd(day: Column) -> Column:
    return day - MJD0


def julian_year(day: Column) -> Column:
    return 2000 + (day - J2000) / 365.25


def besselian_year(day: Column) -> Column:
    return 1900 + (day - 2415020.3135) / 365.242189


def jd_of_julian_year(year: Column) -> Column:
    return J2000 + (year - 2000) * 365.25


def hms(fraction: Column) -> tuple[Column, Column, Column]:
    """Hours, minutes and seconds of a day fraction."""
    s = fraction * 86400
    return F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), s - F.floor(s / 60) * 60


def day_fraction(h: Column, m: Column, s: Column) -> Column:
    return (h * 3600 + m * 60 + s) / 86400


def days_in_month(ts: Column) -> Column:
    return F.dayofmonth(F.last_day(ts))


def sidereal(day: Column, east_longitude: float = 0.0) -> Column:
    """Mean sidereal time as a fraction of a turn; east longitude in radians."""
    t = (day - J2000) / 36525
    degrees = 280.46061837 + 360.98564736629 * (day - J2000) + 0.000387933 * t * t - t * t * t / 38710000
    return F.pmod(degrees / 360 + east_longitude / 6.283185307179586, F.lit(1.0))


def tai_utc(day: Column) -> Column:
    """TAI-UTC seconds in force on a Julian day (null before 1972)."""
    out = F.lit(None).cast("int")
    for start, seconds in LEAP_SECONDS:
        out = F.when(day >= start, F.lit(seconds)).otherwise(out)
    return out


def tt_utc(day: Column) -> Column:
    return tai_utc(day) + 32.184


def easter(year: Column) -> tuple[Column, Column]:
    """Month and day of Gregorian Easter by integer arithmetic."""
    div = lambda a, b: F.floor(a / b)
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    e = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    n = h + e - 7 * div(a + 11 * h + 22 * e, 451) + 114
    return div(n, 31).cast("int"), (n % 31 + 1).cast("int")
