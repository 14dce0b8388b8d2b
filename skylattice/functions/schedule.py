"""Priorities of targets that wait for their next visit, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cadence_weight(waited: Column, cadence: float = 0.7, high: float = 1.1, low: float = 1.0, rise: float = 0.5, decay: float = 2.0) -> Column:
    """Weight by the time since the last visit: a Fermi rise to half of ``high`` before the cadence, then a decay from ``high`` to ``low``.

    The time of the cadence itself belongs to the decay; null gives null.
    """
    late = waited - cadence
    return F.when(late < 0, high / (1 + F.exp(-late / rise))).otherwise(low + (high - low) * F.exp(-late / decay))
