"""Names: synonyms of columns, comparison of schemas, positions by whatever name they have."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skylattice.operators.tables import first_existing

#: Usual names of coordinates and motions, the preferred one first.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "RA": ("RA", "RAJ2000", "Ra", "ra", "ALPHAWIN_J2000", "ra_deg"),
    "Dec": ("Dec", "DEC", "DEJ2000", "DECJ2000", "dec", "DELTAWIN_J2000", "dec_deg"),
    "X": ("X", "x", "XPEAK", "XWIN_IMAGE", "X1"),
    "Y": ("Y", "y", "YPEAK", "YWIN_IMAGE", "Y1"),
    "PMRA": ("PMRA", "pmRA", "pm_ra", "pmra"),
    "PMDec": ("PMDec", "pmDE", "pm_dec", "pmdec"),
    "Plx": ("Plx", "plx", "parallax"),
}


def aliases(key: str, table: Mapping[str, Sequence[str]] = SYNONYMS) -> list[str]:
    """All names of a canonical key, or none."""
    return list(table.get(key, ()))


def canonical(alias: str, table: Mapping[str, Sequence[str]] = SYNONYMS) -> str | None:
    """The canonical key of a name."""
    return next((k for k, names in table.items() if alias == k or alias in names), None)


def resolved(df: DataFrame, keys: Sequence[str], table: Mapping[str, Sequence[str]] = SYNONYMS) -> DataFrame:
    """A column for every canonical key, under that name: the first synonym that the table has, else null."""
    found = {k: first_existing(df, table[k]) for k in keys}
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("double")).alias(k) for k, c in found.items()])


def coordinate_type(df: DataFrame, table: Mapping[str, Sequence[str]] = SYNONYMS) -> str | None:
    """``sphere`` or ``pix`` by the columns that the table has; the sphere where it has both."""
    for kind, keys in (("sphere", ("RA", "Dec")), ("pix", ("X", "Y"))):
        if all(first_existing(df, table[k]) for k in keys):
            return kind
    return None


def common_type(a: DataFrame, b: DataFrame) -> str | None:
    one, two = coordinate_type(a), coordinate_type(b)
    return one if one == two else None


def compared(df: DataFrame, reference: Sequence[str]) -> DataFrame:
    """(pos, name, reference, same) of the columns of a table and reference names, place by place; the longer list decides."""
    n = max(len(df.columns), len(reference))
    at = lambda names, i: names[i] if i < len(names) else None
    rows = [(i + 1, at(df.columns, i), at(reference, i), at(df.columns, i) == at(reference, i)) for i in range(n)]
    return df.sparkSession.createDataFrame(rows, "pos long, name string, reference string, same boolean")


def synonym_table(spark: SparkSession, table: Mapping[str, Sequence[str]] = SYNONYMS) -> DataFrame:
    """The dictionary as rows (alias, key)."""
    return spark.createDataFrame([(a, k) for k, names in table.items() for a in names], "alias string, key string")


def with_canonical(df: DataFrame, alias: str, key: str, table: Mapping[str, Sequence[str]] = SYNONYMS) -> DataFrame:
    """Rows with the canonical key of the name that they carry, null for an unknown one; the dictionary is small and sent out."""
    t = synonym_table(df.sparkSession, table).select(F.col("alias").alias("__alias"), F.col("key").alias(key))
    return df.join(F.broadcast(t), F.col(alias) == F.col("__alias"), "left").drop("__alias")


def coordinate_types(columns: DataFrame, by: str, name: str) -> DataFrame:
    """Coordinate kind of many tables given as rows (table, column name): (by, kind), by the rule of coordinate_type."""
    k = with_canonical(columns.select(by, name), name, "__key")
    has = {c: F.coalesce(F.bool_or(F.col("__key") == c), F.lit(False)) for c in ("RA", "Dec", "X", "Y")}
    return k.groupBy(by).agg(F.when(has["RA"] & has["Dec"], "sphere").when(has["X"] & has["Y"], "pix").alias("kind"))


def filled(df: DataFrame) -> DataFrame:
    """(name, pos, n): position and number of non-null values of every column, in one pass."""
    counts = [F.struct(F.lit(c).alias("name"), F.lit(i + 1).cast("long").alias("pos"), F.count(F.col(f"`{c}`")).alias("n")) for i, c in enumerate(df.columns)]
    return df.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def default_names(n: int) -> list[str]:
    return [f"Var{i}" for i in range(1, n + 1)]


def field_path(schema: StructType, name: str) -> str | None:
    """Dotted path of the first field with a name, at any depth."""
    for f in schema.fields:
        if f.name == name:
            return name
        inner = field_path(f.dataType, name) if isinstance(f.dataType, StructType) else None
        if inner:
            return f"{f.name}.{inner}"
    return None


def nested(path: str, value: Column) -> Column:
    """A dotted path as nested structs around a value; the outermost name is the column's."""
    *outer, last = path.split(".")
    out = value.alias(last)
    for name in reversed(outer):
        out = F.struct(out).alias(name)
    return out


def merged(a: str, b: str, schema: StructType) -> Column:
    """Two structs as one: fields of the first, then those of the second that it lacks."""
    left, right = schema[a].dataType.names, schema[b].dataType.names
    return F.struct(*[F.col(f"{a}.{c}") for c in left], *[F.col(f"{b}.{c}") for c in right if c not in left])
