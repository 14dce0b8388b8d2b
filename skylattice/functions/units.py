"""Unit factors and magnitudes."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sizes of units in the base unit of their kind.
ANGLE = {"rad": 1.0, "deg": math.pi / 180, "arcmin": math.pi / 10800, "arcsec": math.pi / 648000, "mas": math.pi / 648e6, "hour": math.pi / 12}
TIME = {"s": 1.0, "min": 60.0, "hour": 3600.0, "day": 86400.0, "week": 604800.0, "jyear": 31557600.0}
LENGTH = {"mm": 1e-3, "cm": 1e-2, "m": 1.0, "km": 1e3, "au": 149597870700.0, "ly": 9460730472580800.0, "pc": 3.0856775814913673e16, "ang": 1e-10, "nm": 1e-9, "micron": 1e-6}
ENERGY = {"erg": 1e-7, "j": 1.0, "ev": 1.602176634e-19, "kev": 1.602176634e-16, "mev": 1.602176634e-13}
MASS = {"g": 1e-3, "kg": 1.0, "ton": 1e3}
PLANCK, LIGHT = 6.62607015e-34, 299792458.0


def factor(kind: dict[str, float], a: str, b: str) -> float:
    """What a value in unit a is multiplied by to be in unit b."""
    return kind[a.lower()] / kind[b.lower()]


def unit_factor(a: str, b: str) -> float:
    """Factor between products of units such as ``km*s^-1`` and ``m/day``."""
    every = MASS | ENERGY | LENGTH | {k: v for k, v in TIME.items() if k != "min"} | {"minute": 60.0}

    def size(text: str) -> float:
        out = 1.0
        for sign, name, power in re.findall(r"([*/]?)\s*([A-Za-z]+)(?:\^?(-?\d+))?", text):
            out *= every[name.lower()] ** ((-1 if sign == "/" else 1) * int(power or 1))
        return out

    return size(a) / size(b)


def photon_energy(value: Column, unit: str, out: str) -> Column:
    """Between photon energy, wavelength and frequency (hz)."""

    def to_joule(v: Column) -> Column:
        if unit in ENERGY:
            return v * ENERGY[unit]
        return v * PLANCK if unit == "hz" else PLANCK * LIGHT / (v * LENGTH[unit])

    j = to_joule(value)
    if out in ENERGY:
        return j / ENERGY[out]
    return j / PLANCK if out == "hz" else PLANCK * LIGHT / j / LENGTH[out]


def flux_to_mag(flux: Column, zero_point: float) -> Column:
    """Magnitude of a positive flux, else null."""
    return F.when(flux > 0, zero_point - 2.5 * F.log10(flux))


def luptitude(flux: Column, flux0: float, softening: float = 1e-10) -> Column:
    """Inverse hyperbolic sine magnitude, defined for every flux."""
    return -2.5 / math.log(10) * (F.asinh(flux / flux0 / (2 * softening)) + math.log(softening))


def sum_mag(mag: Column) -> Column:
    """Aggregate: the magnitude of the summed fluxes (nulls skipped)."""
    return -2.5 * F.log10(F.sum(F.pow(F.lit(10.0), -0.4 * mag)))


#: Cgs value of a jansky, speed of light in angstrom a second, zero point of AB magnitudes.
JANSKY, LIGHT_ANGSTROM, AB_ZERO = 1e-23, 2.99792458e18, 48.6


def flux_density(value: Column, source: str, target: str, wavelength: Column) -> Column:
    """Between ``jy``, ``mjy``, ``hz`` (erg/s/cm^2/Hz), ``angstrom`` (erg/s/cm^2/A) and ``ab`` magnitudes; wavelength in angstrom."""
    to_hz = {"jy": value * JANSKY, "mjy": value * JANSKY / 1000, "hz": value, "angstrom": value * wavelength * wavelength / LIGHT_ANGSTROM, "ab": F.pow(F.lit(10.0), -0.4 * (value + AB_ZERO))}
    f = to_hz[source]
    return {"jy": f / JANSKY, "mjy": f / JANSKY * 1000, "hz": f, "angstrom": f * LIGHT_ANGSTROM / (wavelength * wavelength), "ab": -2.5 * F.log10(f) - AB_ZERO}[target]
