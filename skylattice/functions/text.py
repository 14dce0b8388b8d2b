"""String helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_spaces(s: Column) -> Column:
    return F.regexp_replace(s, r"\s+", "")


def single_spaces(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, " +", " "))


def leading_number(s: Column) -> Column:
    """The number a string begins with, NaN if none."""
    n = F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(n.try_cast("double"), F.lit(float("nan")))


def is_lower(s: Column) -> Column:
    return s == F.lower(s)


def sexagesimal(value: Column, separator: str = ":") -> Column:
    """Degrees or hours as text with two digits of minutes and seconds with three decimals."""
    ms = F.round(F.abs(value) * 3600000).cast("bigint")
    whole, rest = F.floor(ms / 3600000), ms % 3600000
    sign = F.when(value < 0, "-").otherwise("+")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(sign, two(whole), F.lit(separator), two(F.floor(rest / 60000)), F.lit(separator), two(F.floor(rest % 60000 / 1000)), F.lit("."), F.lpad((rest % 1000).cast("string"), 3, "0"))


def from_sexagesimal(s: Column) -> Column:
    """Inverse of :func:`sexagesimal`; any non-digit separates."""
    p = F.split(F.regexp_replace(F.trim(s), "^[+-]", ""), r"[^0-9.]+")
    v = p[0].cast("double") + p[1].cast("double") / 60 + p[2].cast("double") / 3600
    return F.when(F.trim(s).startswith("-"), -v).otherwise(v)


def search_flag(s: Column, pattern: str, regular: bool = False, case: bool = True) -> Column:
    """Equality or regular search, with or without regard to case."""
    if regular:
        return s.rlike(pattern if case else f"(?i){pattern}")
    return s == pattern if case else F.lower(s) == pattern.lower()


def snake(name: str) -> str:
    """camelCase to snake_case."""
    out = "".join("_" + c.lower() if c.isupper() and i else c.lower() for i, c in enumerate(name))
    return out.replace("__", "_")


def camel(name: str) -> str:
    """snake_case to CamelCase."""
    return "".join(p.capitalize() for p in name.split("_"))


def snake_column(name: Column) -> Column:
    """camelCase to snake_case, for a column of names."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "(?<=.)([A-Z])", "_$1"), "__", "_"))


def camel_column(name: Column) -> Column:
    """snake_case to CamelCase, for a column of names."""
    return F.array_join(F.transform(F.split(name, "_"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), "")


def lines(s: Column) -> Column:
    return F.split(s, r"\r?\n")


def clamped(lo: Column, hi: Column, size: int) -> tuple[Column, Column]:
    """A range of positions brought inside 1..size."""
    inside = lambda x: F.least(F.greatest(x, F.lit(1)), F.lit(size))
    return inside(lo), inside(hi)


def chebyshev(x: Column, order: int) -> Column:
    """Chebyshev polynomial of the first kind by its recurrence."""
    before, now = F.lit(1.0), x
    for _ in range(order - 1):
        before, now = now, 2 * x * now - before
    return now if order else before
