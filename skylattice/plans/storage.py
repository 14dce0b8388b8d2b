"""Reliable checkpoints for iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() in the folder of spark.checkpoint.dir; where that is unset, in the warehouse (local mode: a temporary folder)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        configured = sc.getConf().get("spark.checkpoint.dir", None)
        local = sc.master.startswith("local[")
        sc.setCheckpointDir(configured or (tempfile.mkdtemp(prefix="skylattice-") if local else df.sparkSession.conf.get("spark.sql.warehouse.dir")))
    return df.checkpoint()
