"""skylattice: catalog, time-series and event analytics expressed as Spark plans."""
