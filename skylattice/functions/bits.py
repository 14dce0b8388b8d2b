"""Named bit planes over integer mask columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BitDictionary:
    """Names of bits by position; an unknown name is an error, never an empty mask."""

    names: tuple[str, ...]

    def mask(self, *wanted: str) -> int:
        return sum(1 << self.names.index(w) for w in set(wanted))

    def any_set(self, mask: Column, *wanted: str) -> Column:
        return mask.bitwiseAND(F.lit(self.mask(*wanted))) != 0

    def all_set(self, mask: Column, *wanted: str) -> Column:
        m = self.mask(*wanted)
        return mask.bitwiseAND(F.lit(m)) == m

    def set_where(self, mask: Column, flag: Column, name: str, value: bool = True) -> Column:
        m = self.mask(name)
        return F.when(flag, mask.bitwiseOR(F.lit(m)) if value else mask.bitwiseAND(F.lit(~m))).otherwise(mask)

    def names_of(self, mask: Column) -> Column:
        """Names of the set bits, in order of position."""
        each = [F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(self.names)]
        return F.array_compact(F.array(*each))

    def stat(self, df, mask: str, name: str = "bit"):
        """Count and share of rows with each bit set; one pass, no explosion of rows."""
        agg = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(mask).bitwiseAND(F.lit(1 << i)) != 0).alias(b) for i, b in enumerate(self.names)])
        rows = F.explode(F.array(*[F.struct(F.lit(b).alias(name), F.col(b).alias("n_set"), (F.col(b) / F.col("n")).alias("share")) for b in self.names]))
        return agg.select(rows.alias("r")).select("r.*")
