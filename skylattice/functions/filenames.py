"""Properties in structured file names: fields between underscores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("project", "time", "filter", "field", "counter", "ccd", "crop", "type", "level", "product", "version")


def field(name: Column, wanted: str, fields: Sequence[str] = FIELDS) -> Column:
    """One field of a file name, without its extension; null if the name is too short."""
    base = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[A-Za-z0-9]+$", "")
    return F.get(F.split(base, "_"), F.lit(list(fields).index(wanted)))


def compose(*parts: Column | str, extension: str = "fits") -> Column:
    return F.concat(F.concat_ws("_", *parts), F.lit("." + extension))
